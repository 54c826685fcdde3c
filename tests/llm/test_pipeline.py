import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from remitspark.llm import queries, sql, toxicity
from remitspark.llm.common import stored, table

SF = "/root/testdata/sf0.001"


def test_registered_queries():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 14)]
    assert set(sql.SQL) <= set(queries.QUERIES) and set(queries.QUERIES) <= set(entry.queries()) and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", sorted(sql.SQL))
def test_queries_match_sql(spark, name):
    from tools.check_oracle import canonical

    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    mine = queries.QUERIES[name](spark, SF).toPandas()
    theirs = con.execute(sql.SQL[name]).df()
    assert canonical(mine) == canonical(theirs)


def test_stages(spark):
    from test_exact import expected
    from test_minhash import plain_classes
    from test_mixing import plain_mix, size

    docs = table(spark, SF, "documents")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(stored(stage(spark, kept[-1], SF)))
    ids = [{r["doc_id"] for r in x.select("doc_id").collect()} for x in kept]
    assert all(a.columns == docs.columns for a in kept[:-1])
    rows = [[(r["doc_id"], r["text"], r["source"]) for r in x.collect()] for x in kept[:-1]]
    # toxicity: of the labelled documents those that go are toxic, but for few
    toxic = {r["doc_id"]: r["toxic"] for r in table(spark, SF, "labels").collect()}
    gone = [toxic[i] for i in ids[0] - ids[1] if i in toxic]
    assert sum(gone) >= 0.8 * len(gone) > 0
    scored = toxicity.toxic_rows(docs, table(spark, SF, "labels")).collect()
    assert ids[1] == {r["doc_id"] for r in scored if not r["predicted"]}
    assert ids[2] == {x[0] for x in expected(rows[1]) if x[3]}
    assert ids[3] == {c for _, c, _ in plain_classes(rows[2])}
    taken = {x[0]: x[4] for x in plain_mix(rows[3]) if x[4]}
    mixed = {}
    for i, t, _ in rows[4]:
        mixed[i] = mixed.get(i, 0) + size(t)
    assert mixed == taken
    assert ids[5] == ids[4]
    # packing: every piece of a document follows the one before it, and every sequence is filled from 0 without a gap
    pieces = [r.asDict() for r in kept[-1].collect()]
    for column, place in (("doc_id", "start"), ("sequence_id", "offset")):
        groups = {}
        for p in pieces:
            groups.setdefault(p[column], []).append((p[place], p["length"]))
        for spans in (sorted(x) for x in groups.values()):
            if column == "sequence_id" or len({x for x, _ in spans}) == len(spans):  # a document may stand in the mix several times
                assert [x for x, _ in spans] == list(np.cumsum([0, *(n for _, n in spans)])[:-1])
            assert column == "doc_id" or sum(n for _, n in spans) <= 4096
    assert corpus_pipeline.run(spark, SF).count() == kept[-1].count()
