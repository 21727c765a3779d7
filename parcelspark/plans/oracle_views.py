"""The domain views of :mod:`parcelspark.sources.domain` in SQL, for the oracle side only.

Polygons appear as signed boxes: a parcel is its box minus a notch box minus a
hole box, so overlap areas follow from box intersections alone, independently
of the edge kernels they check.
"""

VIEWS = {
    "v_parcels": """
        SELECT c_custkey AS parcel_id, CAST(floor(c_custkey / 60) AS BIGINT) AS project_id,
               CASE WHEN c_custkey % 19 <> 0 THEN (c_acctbal + 1000) / 11003 END AS confidence,
               CASE WHEN c_custkey % 23 <> 0 THEN (c_custkey * 37 % 101) / 100.0::DOUBLE END AS health,
               CASE c_mktsegment WHEN 'BUILDING' THEN 'ai_processed' WHEN 'AUTOMOBILE' THEN 'needs_review'
                    WHEN 'MACHINERY' THEN 'needs_review' WHEN 'HOUSEHOLD' THEN 'verified' ELSE 'rejected' END AS status,
               CASE c_custkey % 3 WHEN 0 THEN 'ai_extracted' WHEN 1 THEN 'existing_gis' ELSE 'field_verified' END AS source,
               CASE c_custkey % 6 WHEN 0 THEN 'residential' WHEN 1 THEN 'agricultural' WHEN 2 THEN 'commercial'
                    WHEN 3 THEN 'forest' WHEN 4 THEN 'water' END AS land_use,
               CAST(1 + c_custkey % 3 AS INTEGER) AS version
        FROM customer""",
    "v_lattice": """
        SELECT c_custkey AS id, CAST(floor(c_custkey / 60) AS BIGINT) AS project_id,
               CAST(((c_custkey % 60) % 10) * 60 AS DOUBLE) AS x, CAST(floor((c_custkey % 60) / 10) * 60 AS DOUBLE) AS y,
               CAST(50 + (c_custkey * 7) % 23 AS DOUBLE) AS w, CAST(45 + (c_custkey * 11) % 19 AS DOUBLE) AS h
        FROM customer""",
    "v_parcel_boxes": """
        SELECT project_id, id, 1 AS s, x AS x0, y AS y0, x + w AS x1, y + h AS y1 FROM v_lattice
        UNION ALL
        SELECT project_id, id, -1, x + w - 20, y + h - 15, x + w, y + h FROM v_lattice WHERE id % 5 = 0
        UNION ALL
        SELECT project_id, id, -1, x + 10, y + 10, x + 20, y + 20 FROM v_lattice WHERE id % 7 = 0""",
    "v_ref_boxes": """
        SELECT project_id, id, 1 AS s, x + (id * 13) % 9 - 4 AS x0, y + (id * 17) % 9 - 4 AS y0,
               x + (id * 13) % 9 - 4 + w AS x1, y + (id * 17) % 9 - 4 + h AS y1
        FROM v_lattice""",
    "v_parcel_area": """
        SELECT project_id, id, SUM(s * (x1 - x0) * (y1 - y0)) AS area FROM v_parcel_boxes GROUP BY 1, 2""",
    "v_ref_area": """
        SELECT project_id, id, (x1 - x0) * (y1 - y0) AS area FROM v_ref_boxes""",
    "v_parcel_outline": """
        SELECT project_id, id, UNNEST(CASE WHEN id % 5 = 0
                 THEN [[x, y], [x + w, y], [x + w, y + h - 15], [x + w - 20, y + h - 15], [x + w - 20, y + h], [x, y + h]]
                 ELSE [[x, y], [x + w, y], [x + w, y + h], [x, y + h]] END) AS p,
               UNNEST(CASE WHEN id % 5 = 0
                 THEN [[x + w, y], [x + w, y + h - 15], [x + w - 20, y + h - 15], [x + w - 20, y + h], [x, y + h], [x, y]]
                 ELSE [[x + w, y], [x + w, y + h], [x, y + h], [x, y]] END) AS q,
               UNNEST(CASE WHEN id % 5 = 0 THEN [0, 1, 2, 3, 4, 5] ELSE [0, 1, 2, 3] END) AS i
        FROM v_lattice""",
    "v_versions": """
        SELECT o_orderkey AS version_id, o_custkey AS parcel_id, o_orderdate AS captured_at,
               CASE WHEN o_orderkey % 2 = 0 THEN 'ai_extracted' ELSE 'field_verified' END AS source,
               o_totalprice / 100 AS area_sqm
        FROM orders""",
    "v_version_boxes": """
        SELECT o_orderkey AS version_id, o_custkey AS parcel_id, o_orderdate AS captured_at, b.s, b.x0, b.y0, b.x1, b.y1
        FROM orders JOIN v_parcel_boxes b ON b.id = o_custkey WHERE o_orderkey % 4 = 0
        UNION ALL
        SELECT o_orderkey, o_custkey, o_orderdate, 1,
               x + (o_orderkey * 13) % 9 - 4, y + (o_orderkey * 17) % 9 - 4,
               x + (o_orderkey * 13) % 9 - 4 + w + o_orderkey % 5 - 2, y + (o_orderkey * 17) % 9 - 4 + h + o_orderkey % 3 - 1
        FROM orders JOIN v_lattice ON id = o_custkey WHERE o_orderkey % 4 <> 0""",
    "v_corrections": """
        SELECT o_orderkey AS correction_id, o_custkey AS parcel_id,
               CASE left(o_orderpriority, 1) WHEN '1' THEN 'reject_building' WHEN '2' THEN 'reject_road'
                    WHEN '3' THEN 'boundary_adjust' WHEN '4' THEN 'reject' WHEN '5' THEN 'reject_canal' END AS correction_type,
               CASE WHEN o_orderkey % 29 <> 0 THEN o_orderdate END AS created_at
        FROM orders""",
    "v_queue": """
        SELECT o_orderkey AS queue_id, o_custkey AS parcel_id, o_totalprice / 500000 AS priority_score,
               CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'assigned' END AS status,
               CASE WHEN o_orderstatus = 'P' THEN o_orderkey % 120 END AS assigned_to, o_orderdate AS created_at
        FROM orders""",
    "v_evidence": """
        SELECT l_partkey AS parcel_id,
               CASE l_linenumber % 5 WHEN 0 THEN 'segmentation' WHEN 1 THEN 'topology' WHEN 2 THEN 'edge_alignment'
                    WHEN 3 THEN 'deviation_from_baseline' ELSE 'rl_refinement' END AS component,
               round(l_discount * 10, 6) AS score, l_shipdate AS created_at, l_orderkey AS batch, l_linenumber AS line
        FROM lineitem""",
    "v_newest_evidence": """
        SELECT parcel_id, component, score, created_at, batch, line FROM v_evidence
        QUALIFY row_number() OVER (PARTITION BY parcel_id, component ORDER BY created_at DESC, batch DESC, line DESC, score DESC) = 1""",
    "v_anomalies": """
        SELECT event_id AS anomaly_id, user_id AS parcel_id,
               CASE event_type WHEN 'error' THEN 'topology_break' WHEN 'click' THEN 'boundary_shift' WHEN 'view' THEN 'overlap'
                    WHEN 'purchase' THEN 'encroachment' WHEN 'signup' THEN 'false_positive_road' ELSE 'overlap' END AS type,
               value AS magnitude, ts AS detected_at, props
        FROM events""",
    "v_projects": """
        SELECT project_id, CASE WHEN project_id % 5 = 0 THEN 'DEMO_' ELSE 'project_' END || CAST(project_id AS VARCHAR) AS name,
               CASE project_id % 3 WHEN 0 THEN 'review' WHEN 1 THEN 'created' ELSE 'completed' END AS status
        FROM (SELECT DISTINCT CAST(floor(c_custkey / 60) AS BIGINT) AS project_id FROM customer)""",
    "v_pixels": """
        SELECT CAST(floor(vec_id / 64) AS BIGINT) AS raster_id, vec_id % 64 AS row, CAST(i - 1 AS BIGINT) AS col,
               CASE WHEN ((vec_id % 64) * (i - 1)) % 29 = 28 THEN -1.0::DOUBLE
                    ELSE least(1.0::DOUBLE, abs(CAST(embedding[i] AS DOUBLE)) * 4) END AS value
        FROM embeddings, range(1, 65) t(i)""",
    "v_labels": """
        SELECT raster_id, row, col, value,
               CASE WHEN value < 0 THEN 255 WHEN (row * 31 + col * 17) % 11 = 0 THEN 1 ELSE 0 END AS label,
               CASE (row + col) % 7 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 4 ELSE 0 END AS hard
        FROM v_pixels""",
    "v_bands": """
        SELECT CAST(floor(vec_id / 64) AS BIGINT) AS raster_id, vec_id % 64 AS row, CAST(i - 1 AS BIGINT) AS col,
               CAST(g AS DOUBLE) AS red, CAST((g * 3 + i - 1) % 256 AS DOUBLE) AS green, CAST((g * 5 + vec_id) % 256 AS DOUBLE) AS blue
        FROM (SELECT vec_id, i, CAST(floor(abs(CAST(embedding[i] AS DOUBLE)) * 2000) AS BIGINT) % 256 AS g
              FROM embeddings, range(1, 65) t(i))""",
    "v_volatility": """
        SELECT parcel_id, coalesce(avg(least(1.0, abs(area_sqm - prev) / nullif(prev, 0))) FILTER (WHERE prev IS NOT NULL), 0) AS volatility
        FROM (SELECT parcel_id, area_sqm, lag(area_sqm) OVER (PARTITION BY parcel_id ORDER BY captured_at, version_id) AS prev
              FROM v_versions) GROUP BY 1""",
    "v_overlap_pairs": """
        SELECT a.project_id, a.id AS l_id, b.id AS r_id,
               SUM(a.s * b.s * greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0))
                           * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0))) AS inter_area
        FROM v_parcel_boxes a JOIN v_parcel_boxes b ON a.project_id = b.project_id AND a.id < b.id GROUP BY 1, 2, 3""",
    "v_topology": """
        SELECT p.project_id, p.id, p.id IN (
                 SELECT UNNEST([l_id, r_id]) FROM v_overlap_pairs o
                 JOIN v_parcel_area a ON a.id = l_id JOIN v_parcel_area b ON b.id = r_id
                 WHERE inter_area > 1e-6 AND inter_area < least(a.area, b.area) - 1e-6) AS topology_violation
        FROM v_lattice p""",
    "v_latest_version": """
        SELECT parcel_id, version_id, captured_at, source, area_sqm FROM v_versions
        QUALIFY row_number() OVER (PARTITION BY parcel_id ORDER BY captured_at DESC, version_id DESC) = 1""",
    "v_version_overlay": """
        SELECT v.version_id, v.parcel_id, v.captured_at,
               (SELECT area FROM v_parcel_area pa WHERE pa.id = v.parcel_id) AS current_area, v.historical_area, i.inter_area
        FROM (SELECT version_id, parcel_id, captured_at, SUM(s * (x1 - x0) * (y1 - y0)) AS historical_area
              FROM v_version_boxes GROUP BY 1, 2, 3) v
        JOIN (SELECT version_id, SUM(p.s * v.s * greatest(0, least(p.x1, v.x1) - greatest(p.x0, v.x0))
                                        * greatest(0, least(p.y1, v.y1) - greatest(p.y0, v.y0))) AS inter_area
              FROM v_version_boxes v JOIN v_parcel_boxes p ON p.id = v.parcel_id GROUP BY 1) i USING (version_id)""",
    "v_moments": """
        SELECT id, SUM(s * (x1 - x0) * (y1 - y0)) AS a,
               SUM(s * (x1 - x0) * (y1 - y0) * (x0 + x1) / 2) / SUM(s * (x1 - x0) * (y1 - y0)) AS cx,
               SUM(s * (x1 - x0) * (y1 - y0) * (y0 + y1) / 2) / SUM(s * (x1 - x0) * (y1 - y0)) AS cy
        FROM v_parcel_boxes GROUP BY 1""",
    "v_version_moments": """
        SELECT version_id, SUM(s * (x1 - x0) * (y1 - y0) * (x0 + x1) / 2) / SUM(s * (x1 - x0) * (y1 - y0)) AS cx,
               SUM(s * (x1 - x0) * (y1 - y0) * (y0 + y1) / 2) / SUM(s * (x1 - x0) * (y1 - y0)) AS cy
        FROM v_version_boxes GROUP BY 1""",
    "v_discrepancy": """
        SELECT o.parcel_id, 0.4 * least(ratio, 1.0) + 0.6 * least(sym, 1.0) AS raw, ratio, sym,
               sqrt((m.cx - vm.cx) ** 2 + (m.cy - vm.cy) ** 2) AS shift
        FROM (SELECT *, abs(current_area - historical_area) / greatest(historical_area, 1e-9) AS ratio,
                     (current_area + historical_area - 2 * inter_area) / (current_area + historical_area - inter_area) AS sym
              FROM v_version_overlay) o
        JOIN v_latest_version l ON l.version_id = o.version_id
        JOIN v_moments m ON m.id = o.parcel_id JOIN v_version_moments vm ON vm.version_id = o.version_id""",
}

VIEWS.update({
    # closed outline edges with their start and end along the exterior; holes are separate
    "v_parcel_edges": """
        SELECT project_id, id, 0 AS ring, i, p[1] AS x1, p[2] AS y1, q[1] AS x2, q[2] AS y2 FROM v_parcel_outline
        UNION ALL
        SELECT project_id, id, 1, UNNEST([0, 1, 2, 3]), UNNEST([x + 10, x + 10, x + 20, x + 20]), UNNEST([y + 10, y + 20, y + 20, y + 10]),
               UNNEST([x + 10, x + 20, x + 20, x + 10]), UNNEST([y + 20, y + 20, y + 10, y + 10])
        FROM v_lattice WHERE id % 7 = 0""",
    "v_ref_edges": """
        SELECT project_id, id, 0 AS ring, UNNEST([0, 1, 2, 3]) AS i, UNNEST([x0, x1, x1, x0]) AS x1, UNNEST([y0, y0, y1, y1]) AS y1,
               UNNEST([x1, x1, x0, x0]) AS x2, UNNEST([y0, y1, y1, y0]) AS y2
        FROM v_ref_boxes""",
    "v_parcel_ref_inter": """
        SELECT a.project_id, a.id AS a_id, b.id AS b_id,
               SUM(a.s * b.s * greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0))
                           * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0))) AS inter_area
        FROM v_parcel_boxes a JOIN v_ref_boxes b ON a.project_id = b.project_id GROUP BY 1, 2, 3""",
    "v_iou": """
        SELECT i.project_id, a_id, b_id, CASE WHEN inter_area > 0 THEN inter_area / (a.area + b.area - inter_area) ELSE 0 END AS iou
        FROM v_parcel_ref_inter i JOIN v_parcel_area a ON a.id = a_id JOIN v_ref_area b ON b.id = b_id""",
    "v_nearest": """
        SELECT i.project_id, i.a_id AS source_id, i.b_id AS target_id,
               CASE WHEN i.inter_area > 1e-9 THEN 0 ELSE g.gap END AS distance
        FROM v_parcel_ref_inter i JOIN (
          SELECT e.id AS a_id, g.id AS b_id, min(sqrt(
                   greatest(0, least(e.x1, e.x2) - greatest(g.x1, g.x2), least(g.x1, g.x2) - greatest(e.x1, e.x2)) ** 2 +
                   greatest(0, least(e.y1, e.y2) - greatest(g.y1, g.y2), least(g.y1, g.y2) - greatest(e.y1, e.y2)) ** 2)) AS gap
          FROM v_parcel_edges e JOIN v_ref_edges g ON e.project_id = g.project_id GROUP BY 1, 2) g USING (a_id, b_id)
        QUALIFY row_number() OVER (PARTITION BY i.a_id ORDER BY CASE WHEN i.inter_area > 1e-9 THEN 0 ELSE g.gap END, i.b_id) = 1""",
    "v_samples": """
        SELECT layer, project_id, id, s AS sample,
               x1 + (s * (total / 96) - f) / len * (x2 - x1) AS sx, y1 + (s * (total / 96) - f) / len * (y2 - y1) AS sy
        FROM (SELECT *, sum(len) OVER (PARTITION BY layer, id ORDER BY i) - len AS f, sum(len) OVER (PARTITION BY layer, id) AS total
              FROM (SELECT layer, project_id, id, i, x1, y1, x2, y2, abs(x2 - x1) + abs(y2 - y1) AS len FROM (
                      SELECT 'a' AS layer, * FROM v_parcel_edges WHERE ring = 0 UNION ALL SELECT 'b', * FROM v_ref_edges))) e,
             range(0, 96) t(s)
        WHERE s * (total / 96) >= f AND s * (total / 96) < f + len""",
    "v_directed": """
        SELECT n.source_id, n.target_id, s.layer, s.sample, min(sqrt(
                 greatest(0, least(g.x1, g.x2) - s.sx, s.sx - greatest(g.x1, g.x2)) ** 2
                 + greatest(0, least(g.y1, g.y2) - s.sy, s.sy - greatest(g.y1, g.y2)) ** 2)) AS d
        FROM v_nearest n JOIN v_samples s ON (s.layer = 'a' AND s.id = n.source_id) OR (s.layer = 'b' AND s.id = n.target_id)
        JOIN (SELECT 'b' AS layer, id, x1, y1, x2, y2 FROM v_ref_edges UNION ALL SELECT 'a', id, x1, y1, x2, y2 FROM v_parcel_edges) g
          ON g.layer <> s.layer AND g.id = CASE WHEN s.layer = 'a' THEN n.target_id ELSE n.source_id END
        GROUP BY 1, 2, 3, 4""",
    "v_boundary_distance": """
        SELECT source_id, target_id, (avg(d) FILTER (WHERE layer = 'a') + avg(d) FILTER (WHERE layer = 'b')) / 2 AS boundary_distance
        FROM v_directed GROUP BY 1, 2""",
})
