"""Each stage of the pipeline on what the one before kept, against brute force."""

import hashlib
from collections import Counter

from tests.llm.conftest import words
from tests.llm.test_operators import linked

FOLDER = "/root/testdata/sf0.01"


def test_stages(spark):
    import public_tokenizers as P

    import corpus_pipeline as cp
    from tessera.llm.bpe import ByteBpe
    from tessera.llm.storage import kept

    raw = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, (classify, near, cut, mix, encode) = raw.columns, [f for _, f in cp.STAGES]
    assert 4 <= len(cp.STAGES) <= 5 and cp.ORACLE_SQL is None

    good = kept(classify(spark, raw, FOLDER), "t")
    assert good.columns == columns and 0.7 * raw.count() < good.count() < raw.count()
    assert good.exceptAll(raw).isEmpty()

    one = kept(near(spark, good, FOLDER), "t")
    rows = [(r.doc_id, r.text) for r in good.collect()]
    assert {r.doc_id for r in one.collect()} == {c for *_, c in linked(rows)} and one.exceptAll(good).isEmpty()

    clean = kept(cut(spark, one, FOLDER), "t")
    texts = {r.doc_id: r.text for r in one.collect()}
    seen = Counter(tuple(w[i : i + 35]) for w in map(words, texts.values()) for i in range(len(w) - 34))
    for r in clean.collect():
        w = words(texts[r.doc_id])
        gone = {j for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        assert r.text == (" ".join(x for i, x in enumerate(w) if i not in gone) if gone else texts[r.doc_id])
        assert r.n_chars == len(r.text)
    assert clean.columns == columns and clean.count() == one.count()

    mixed = kept(mix(spark, clean, FOLDER), "t")
    copies = Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == columns and max(copies.values()) <= 3 and mixed.dropDuplicates().exceptAll(clean).isEmpty()

    bpe = ByteBpe(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    left = {r.doc_id: r.text for r in mixed.collect()}
    out = encode(spark, mixed, FOLDER).collect()
    assert len(out) == mixed.count()
    for r in out:
        assert bpe.decode(" ".join(map(str, r.ids))) == left[r.doc_id].encode() and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(left[r.doc_id].encode()).hexdigest()


def test_run_and_absence(spark):
    """The whole run; and the rest of the library without this subpackage."""
    import subprocess
    import sys

    import corpus_pipeline as cp

    assert cp.run(spark, FOLDER).count() > 0
    code = "import sys; sys.modules['corpus_pipeline'] = None; sys.modules['tessera.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and len(q) > 60, len(q)"
    assert subprocess.run([sys.executable, "-c", code], capture_output=True).returncode == 0


def test_stages_on_odd_rows(spark, edges, none):
    """Nulls, empty and long texts, repeated rows and columns with clashing names go through every stage; an empty table stays empty."""
    from pyspark.sql import functions as F

    import corpus_pipeline as cp
    from tessera.llm.storage import kept

    clashing = edges.withColumns({c: F.lit(7) for c in ("_id", "_draw", "_times", "_copy", "doc", "own", "draw", "times", "id", "words", "bucket")})
    for docs, rows in ((clashing, edges.count()), (none, 0)):
        columns = docs.columns
        for (name, stage), least in zip(cp.STAGES[:-1], (rows, rows - 2, rows - 2, 1 if rows else 0), strict=True):
            docs = kept(stage(spark, docs, FOLDER), "odd")
            assert docs.columns == columns, name
            n = docs.count()
            assert (n >= least or name == "quality classifier") and (n > 0) == (rows > 0), (name, n)
            assert "_id" not in columns or {tuple(r) for r in docs.select("_id", "_draw", "_times", "_copy", "draw", "times").collect()} == {(7,) * 6}
            if name == "quality classifier":  # the rest goes on with all rows
                docs = kept(clashing if rows else none, "odd")
        out = cp.STAGES[-1][1](spark, docs, FOLDER).collect()
        assert len(out) == docs.count() and all(r.n_tokens == len(r.ids) for r in out)
