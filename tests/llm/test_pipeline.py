import public_tokenizers
from pyspark.sql import functions as F
from samples import prose
from test_models import bags
from test_simhash import plain_components, plain_fingerprint
from tokenizers import Tokenizer

import corpus_pipeline
from tidelog import session
from tidelog.llm.simhash import drop_near_copies

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def write(spark, root, docs, labels, items):
    spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in docs], SCHEMA).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")


def test_stages_against_plain_versions(spark, tmp_path):
    root = f"file://{tmp_path}"
    rows = bags(200, "p")
    items = [(1, prose("i1", 20)), (2, prose("i2", 20))]
    docs = [(i, t) for i, (t, _) in enumerate(rows)]
    docs += [(300, rows[3][0]), (301, rows[4][0] + " onst"), (302, f"{prose(5, 30)} {items[0][1]} {prose(6, 30)}"), (303, f"{items[0][1]} {items[1][1]}")]
    docs += [(304, prose(8, 30) + " password=hunter22 " + prose(9, 30)), (305, None), (306, ""), (307, prose(10, 3000))]
    write(spark, root, docs, [(i, 1, t) for i, (_, t) in enumerate(rows)], items)
    got = spark.read.parquet(f"{root}/documents.parquet")
    names = got.columns
    by = dict(docs)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = sorted((r.doc_id, r.text) for r in got.collect())
        got = stage(spark, got, root)
        assert got.columns == names
        path = f"{root}/{name.replace(' ', '-')}"
        got.write.parquet(path)
        got = spark.read.parquet(path)
        after = {r.doc_id: r.text for r in got.collect()}
        assert len(after) == got.count()
        if name == "toxicity":
            wrong = [i for i, (_, t) in enumerate(rows) if (i in after) == bool(t)]
            assert len(wrong) <= 6 and {302, 303, 304, 305, 306, 307} <= set(after)
            assert all(by[i] == t for i, t in after.items())
        elif name == "simhash near-dedup":
            root_of = plain_components([plain_fingerprint(t) for _, t in before])
            assert sorted(after) == sorted({before[k][0] for k in root_of})
        elif name == "benchmark decontamination":
            assert set(dict(before)) - set(after) == {303}
            assert items[0][1] not in after[302] and after[302].startswith(prose(5, 30)) and after[302].endswith(prose(6, 30))
            assert all(after[i] == t for i, t in before if i not in (302, 303))
        else:
            assert set(after) == set(dict(before)) and "[SECRET]" in after[304] and "hunter22" not in after[304]
            assert all(after[i] == t for i, t in before if i != 304)
        assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got.collect())
    texts = {r.doc_id: r.text for r in got.collect()}
    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    packed = corpus_pipeline.STAGES[-1][1](spark, got, root)
    sizes = {r.doc_id: r.n for r in packed.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert sizes == {i: len(model.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in texts.items()}
    whole = corpus_pipeline.run(spark, root)
    assert sorted(map(tuple, whole.select("doc_id", "start", "ids_crc32").collect())) == sorted(map(tuple, packed.select("doc_id", "start", "ids_crc32").collect()))


def test_repeated_and_null_ids_and_no_rows(spark, tmp_path):
    root = f"file://{tmp_path}"
    one, two = prose(1, 40), prose(3, 40)
    rows = [(1, one), (1, one), (1, two), (2, one), (None, one), (None, prose(4, 40)), (None, prose(4, 40)), (3, None), (4, ""), (None, None), (5, two), (5, two)]
    write(spark, root, rows, [(1, 1, 0)], [(1, prose(2, 20))])
    docs = spark.read.parquet(f"{root}/documents.parquet")
    for list_rows in (8192, 2):
        kept = drop_near_copies(docs, list_rows=list_rows)
        assert sorted((r.doc_id or -1, r.text or "") for r in kept.collect()) == sorted([(1, one), (1, two), (-1, prose(4, 40)), (3, "")])
    none = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, root).count() == 0


def test_rows_alike_but_for_other_columns(spark):
    rows = [(i % 2, prose(i % 2, 30), s) for i in range(6) for s in ("x", "y", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `id` string")
    got = [sorted(map(tuple, drop_near_copies(df.repartition(n)).collect())) for n in (1, 3, 5)]
    assert len(got[0]) == 2 and got[0] == got[1] == got[2]


def test_clashing_columns_pass_through(spark, edge_docs, no_docs, tmp_path):
    root = f"file://{tmp_path}"
    write(spark, root, [(1, "a")], [(1, 1, 0), (2, 1, 1)], [(1, prose(2, 20))])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, no_docs, root).columns == edge_docs.columns
        out = stage(spark, edge_docs, root)
        assert out.columns == edge_docs.columns and 0 < out.count() <= edge_docs.count()


def test_what_stages_keep_is_removed(spark, tmp_path, monkeypatch):
    """After a run only what its result is read from is left."""
    root, shared = f"file://{tmp_path}/sf", tmp_path / "shared"
    rows = bags(60, "p")
    write(spark, root, [(i, t) for i, (t, _) in enumerate(rows)], [(i, 1, t) for i, (_, t) in enumerate(rows)], [(1, prose("i1", 20))])
    monkeypatch.setattr(session, "shared_dir", lambda _: f"file://{shared}")
    out = corpus_pipeline.run(spark, root)
    left = {p.name.rsplit("-", 1)[0] for p in (shared / "tidelog").iterdir()}
    assert left == {"secret-scans", "pieces", "piece-lengths", "piece-ranks"} and out.count() > 0
