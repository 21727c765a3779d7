"""Declared schemas of stored tables and exchanged documents."""

POLYGON = "struct<type:string,coordinates:array<array<array<double>>>>"
RINGS = "array<array<struct<x:double,y:double>>>"

TABLES = {
    "projects": f"id string, name string, area_of_interest {RINGS}, status string, created_at timestamp, updated_at timestamp",
    "parcels": (
        f"id string, project_id string, rings {RINGS}, source string, status string, confidence_score double, "
        "health_score double, land_use string, area_sqm double, version int, created_at timestamp, updated_at timestamp"),
    "buildings": f"id string, project_id string, parcel_id string, rings {RINGS}, confidence_score double",
    "roads": f"id string, project_id string, rings {RINGS}, confidence_score double",
    "parcel_versions": f"id string, parcel_id string, rings {RINGS}, captured_at timestamp, source string",
    "confidence_evidence": "id string, parcel_id string, component string, score double, explanation string",
    "corrections": (
        f"id string, parcel_id string, surveyor_id string, original_rings {RINGS}, corrected_rings {RINGS}, "
        "correction_type string, created_at timestamp"),
    "survey_queue": (
        "id string, parcel_id string, priority_score double, reason string, status string, assigned_to string, "
        "created_at timestamp"),
    "anomalies": "id string, parcel_id string, type string, magnitude double, detected_at timestamp",
    "users": "id string, name string, email string, role string",
    "vendors": "id string, name string, services string, contact string",
}

# Properties stay JSON text per feature: the property set is open.
FEATURE_COLLECTION = (
    f"type string, schema_version string, features array<struct<type:string,geometry:{POLYGON},properties:string>>")

PAYLOAD = (
    f"parcel_id string, geometry {POLYGON}, confidence_score double, segmentation_score double, topology_score double, "
    "edge_alignment_score double, deviation_from_baseline_score double, explanation string, demo boolean, "
    f"metadata struct<baseline_geometry:{POLYGON},policy_sha256:string,timesteps:bigint,accepted:boolean,changed:boolean>")

RECORD = (
    "struct<name:string,split:string,source:string,image:string,probability:string,reference:string,reference_lines:string,"
    "reference_faces:string,hard_negative_features:string,hard_negative_counts:map<string,bigint>,hard_negative_count:bigint,"
    "crs:string,transform:array<double>,bounds:array<double>,shape:array<int>,reference_count:bigint,"
    "reference_line_length_m:double,reviewed_parcel_ids:array<string>,positive_boundary_count:bigint>")

MANIFEST = (
    f"version string, records array<{RECORD}>, name string, image string, crs string, transform array<double>, "
    "bounds array<double>, shape array<int>, target_aoi_used_for_parameter_selection boolean, target_aoi_used_for_test boolean, "
    "target_aoi_used_for_training_or_selection boolean, review_summary struct<training_ready:boolean>, "
    "matched_review_summary struct<training_ready:boolean>")

COMPARISON = (
    "struct<candidate_count:bigint,reference_count:bigint,invalid_candidates:bigint,candidate_mean_best_iou:double,"
    "reference_mean_best_iou:double,harmonic_mean_best_iou:double,reference_matched_iou_50:bigint,"
    "reference_matched_iou_75:bigint,mean_symmetric_boundary_distance_m:double,median_candidate_area_m2:double,"
    "median_reference_area_m2:double>")

REPORTS = {
    "comparison": (
        f"crs_for_metrics string, old_cleaned_output {COMPARISON}, new_enclosed_face_vectorization {COMPARISON}, "
        f"candidate {COMPARISON}, baseline {COMPARISON}, harmonic_iou_delta_from_old double, "
        "validation_harmonic_iou_delta double, target_harmonic_iou_delta double, promoted boolean, "
        "target_reference_used_for_parameter_selection boolean"),
    "refinement": (
        "parcel_count_before bigint, parcel_count_after bigint, invalid_before bigint, invalid_after bigint, "
        "overlap_pairs_before bigint, overlap_pairs_after bigint, changed_parcels bigint, "
        "mean_boundary_displacement_m double, alignment_before double, alignment_after double, reward_mean double, "
        "reward_std double, policy_sha256 string, timesteps bigint, reference_used_during_inference boolean"),
    "calibration": (
        "profile string, selection_objective double, trial_count bigint, target_candidate_count bigint, "
        "validation_metrics struct<mean_harmonic_iou:double,worst_harmonic_iou:double,harmonic_mean_best_iou:double>"),
    "training": "version string, pixel_promotion_gate_passed boolean, training_patch_count bigint",
}

OSM = (
    "elements array<struct<id:bigint,type:string,tags:map<string,string>,"
    "geometry:array<struct<lat:double,lon:double>>>>")
