"""The pipeline's stages on a small corpus: what each takes out, what it leaves, and how they go together."""

import hashlib
import random

import pytest

import corpus_pipeline as P
import public_tokenizers
from lethe.llm import byte_bpe, decontaminate, near_dup, repeats, suffix_dedup, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "kept"]


def words(r, n, name="w"):
    return [f"{name}{r.randrange(4000)}" for _ in range(n)]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Clean texts, toxic ones, near copies, a passage of two documents, a benchmark item, null and empty texts, null ids."""
    r = random.Random(12)
    insults = ["idiot", "moron", "scum"]
    clean = [" ".join(words(r, 60)) for _ in range(60)]
    toxic = [" ".join(r.choice(insults) if r.random() < 0.3 else w for w in words(r, 60)) for _ in range(60)]
    item = words(r, 30, "q")
    base = words(r, 120)
    copy = base[:60] + ["changed"] + base[61:]
    passage = " ".join(words(r, 40, "p"))
    extra = [" ".join(base), " ".join(copy), " ".join(["x", *words(r, 80), passage, *words(r, 80), "y"]), " ".join(["u", *words(r, 80), passage, *words(r, 80), "v"]), " ".join(words(r, 20) + item + words(r, 20)), None, ""]
    texts = clean + toxic + extra
    rows = [(i, t, "en", "s", "clash") for i, t in enumerate(texts)] + [(None, "no id " + clean[0], "en", "s", "clash"), (0, clean[0], "en", "s", "clash")]
    at = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(7, " ".join(item))], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(60 <= i < 120)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at), {i: t for i, t in enumerate(texts)}, passage


def read(spark, at):
    return spark.read.parquet(f"{at}/documents.parquet")


def test_order_and_columns(spark, corpus):
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_duplicates", "repeated_bytes", "decontamination", "byte_bpe"]
    at, *_ = corpus
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, read(spark, at), at).columns == COLUMNS


def test_toxic_documents_go(spark, corpus):
    at, texts, _ = corpus
    kept = [r.doc_id for r in P.reject_toxic(spark, read(spark, at), at).collect()]
    gone = set(texts) - set(kept)
    assert len(gone & set(range(60, 120))) >= 57 and len(gone - set(range(60, 120))) <= 2
    assert None in kept and kept.count(0) == 2 and {125, 126} <= set(kept)


def test_below_is_scores(spark, corpus):
    at, *_ = corpus
    labels = spark.read.parquet(f"{at}/labels.parquet").selectExpr("doc_id", "toxic as label")
    docs = read(spark, at).where("doc_id is not null").distinct()
    model = toxicity.fit(docs, labels)
    scored = {r.doc_id for r in toxicity.scores(docs, model).where(f"score < {toxicity.THRESHOLD}").collect()}
    assert {r.doc_id for r in toxicity.below(docs, model).collect()} == scored
    assert toxicity.below(docs, None).count() in (0, docs.count())


def test_one_of_each_component_stays(spark, corpus):
    at, texts, _ = corpus
    kept = [r.doc_id for r in near_dup.one_of_each(read(spark, at)).collect()]
    assert set(texts) - set(kept) == {121} and None in kept and kept.count(0) == 2


def test_repeated_bytes_are_cut(spark, corpus):
    at, texts, passage = corpus
    got = {r.doc_id: r.text for r in suffix_dedup.without_repeats(read(spark, at)).collect() if r.doc_id is not None}
    assert got[122] == texts[122] and passage not in got[123] and got[123].startswith("u") and got[123].endswith("v")
    assert got[125] is None and got[126] == "" and got[3] == texts[3]


def test_repeats_at_the_start_of_texts_are_cut(spark, tmp_path, monkeypatch):
    """Texts of one window each whose minimizer stands first: a shard of two such pieces has nothing to the left."""
    monkeypatch.setattr(repeats, "SHARD_BYTES", 1)
    r = random.Random(5)
    common = ["".join(chr(r.randrange(97, 123)) for _ in range(99)) for _ in range(200)]
    texts = [c + end for c in common for end in "xy"]
    rows = [(i, t, "en", "s", "clash") for i, t in enumerate(texts)] + [(len(texts) + i, t, "en", "s", "clash") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1)
    got = {r.doc_id: r.text for r in P.cut_repeated_bytes(spark, read(spark, tmp_path), str(tmp_path)).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {i: t if i < len(texts) else "" for i, (_, t, *_) in enumerate(rows)}


def test_contaminated_documents_go(spark, corpus):
    at, texts, _ = corpus
    kept = [r.doc_id for r in decontaminate.clean(read(spark, at), spark.read.parquet(f"{at}/benchmark.parquet")).collect()]
    assert set(texts) - set(kept) == {124} and None in kept


def test_bytes_are_encoded(spark, corpus):
    at, texts, _ = corpus
    ranks = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    back = {i: b for b, i in ranks.items()}
    for r in P.encode_bytes(spark, read(spark, at), at).collect():
        if r.doc_id:
            assert b"".join(back[i] for i in r.ids) == (texts[r.doc_id] or "").encode() and r.n_tokens == len(r.ids)


def test_run(spark, corpus):
    at, texts, passage = corpus
    docs = read(spark, at)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, at)
    seen = lambda df: sorted((str(r.doc_id), r.n_tokens, hashlib.sha256(str(r.ids).encode()).hexdigest()) for r in df.collect())
    got = P.run(spark, at)
    rows = got.collect()
    assert got.columns == ["doc_id", "n_tokens", "ids"] and seen(got) == seen(docs)
    left = {r.doc_id for r in rows}
    assert {120, 122, 123, 125, 126, None} <= left and not {121, 124} & left and len(left & set(range(60, 120))) <= 3
    assert len(left & set(range(60))) >= 58
