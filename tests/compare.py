import duckdb

SF = "/root/testdata/sf0.001"


def rows(arrow):
    cols = sorted(arrow.column_names)
    return cols, sorted((tuple(repr(v) for v in r) for r in zip(*(arrow[c].to_pylist() for c in cols))))


def oracle(sql, sf=SF, tables=("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in tables:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c.execute(sql).to_arrow_table()
