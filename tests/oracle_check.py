"""Compare registered queries with their oracle SQL. Usage: python tests/oracle_check.py SF_DIR [name ...]"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(v):
        if isinstance(v, bool) or v is None:
            return v
        if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
            f = float(v)
            return 0.0 if f == 0 else f
        return str(v)

    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name, run, sql, sf_dir):
    df = run(spark, sf_dir)
    got = canonical([tuple(r) for r in df.collect()], df.columns)
    if sql is None:
        return len(got), None
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = canonical(cur.fetchall(), cols)
    assert sorted(df.columns) == sorted(cols), (name, sorted(df.columns), sorted(cols))
    diff = [(a, b) for a, b in zip(got, want) if a != b]
    return len(got), (len(got) == len(want) and not diff, len(want), diff[:3])


def main():
    import __spark_entry__
    from parcelspark.session import get_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = get_session("check", master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    bad = 0
    oracles = __spark_entry__.oracle_sql()
    for name, run in __spark_entry__.queries().items():
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        t = time.time()
        try:
            rows, result = compare(spark, con, name, run, oracles.get(name), sf_dir)
            status = "ROWS" if result is None else ("OK" if result[0] else "DIFF")
        except Exception as error:  # report and go on
            rows, result, status = 0, str(error)[:1500], "ERROR"
        bad += status in ("DIFF", "ERROR")
        print(f"{status:5} {name} rows={rows} {time.time() - t:.1f}s", "" if status in ("OK", "ROWS") else result, flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
