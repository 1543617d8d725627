"""Results of queries beside DuckDB's."""

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return None if x != x else round(x, 9)
    if isinstance(x, list):
        return tuple(plain(i) for i in x)
    return x


def rows(table):
    names = sorted(table.column_names)
    return names, sorted(map(repr, zip(*[[plain(v) for v in table.column(n).to_pylist()] for n in names], strict=True)))


def duck(sql, sf_dir=None, **tables):
    import duckdb

    con = duckdb.connect()
    for name in TABLES if sf_dir else ():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    for name, table in tables.items():
        con.register(name, table)
    return con.execute(sql).to_arrow_table()
