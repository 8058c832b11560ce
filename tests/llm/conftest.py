import duckdb
import pytest

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def oracle():
    """Runs DuckDB SQL over a folder of tables: a set of rows with the columns in the order of their names."""

    def run(sql: str, sf_dir: str):
        con = duckdb.connect()
        for n in NAMES:
            con.execute(f"CREATE VIEW {n} AS SELECT * FROM read_parquet('{sf_dir}/{n}.parquet')")
        found = con.execute(sql)
        names = [d[0] for d in found.description]
        order = sorted(range(len(names)), key=names.__getitem__)
        return sorted(tuple(r[i] for i in order) for r in found.fetchall())

    return run


@pytest.fixture(scope="session")
def rows():
    def get(df):
        names = sorted(df.columns)
        return sorted(tuple(r[n] for n in names) for r in df.collect())

    return get
