
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from lintlake.llm import secrets, stages, toxicity
from tests.llm.test_jaccard import brute
from tests.llm.test_tokens import check_packed


def rows_of(frame):
    return {r["doc_id"]: r for r in frame.collect()}


def test_stages_equal_plain_versions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    state = rows_of(docs)
    frames = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        frames[name] = docs
        if name != "packing":
            assert docs.columns == columns
            docs = docs.cache()
    model = toxicity.fit(toxicity.training_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")))
    ids = list(state)
    toxic = {i for i, s in zip(ids, model.scores([state[i]["text"] or "" for i in ids])) if s >= 0.5}
    state = {i: r for i, r in state.items() if i not in toxic}
    assert rows_of(frames["toxicity"]) == state
    state = {i: r for i, r in state.items() if any(map(str.isalpha, r["text"] or ""))}
    assert rows_of(frames["language"]) == state
    gone = {i for i, n, c in brute([(i, r["text"]) for i, r in state.items()]) if n and i != c}
    state = {i: r for i, r in state.items() if i not in gone}
    assert rows_of(frames["near_duplicates"]) == state and gone
    coder = secrets.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    texts = {i: secrets.redact(r["text"], secrets.spans_of(r["text"], coder)[1]) for i, r in state.items()}
    got = rows_of(frames["secrets"])
    assert {i: r["text"] for i, r in got.items()} == texts
    tk = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    packed = frames["packing"].collect()
    check_packed(packed, 4096)
    sizes = {}
    for r in packed:
        sizes[r["doc_id"]] = sizes.get(r["doc_id"], 0) + r["length"]
    assert sizes == {i: len(tk.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts.items()}


def test_odd_rows(spark, tmp_path):
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    text = "some words of a text that is long enough to be more than one set"
    rows = [(1, text, "en", "s", 5), (2, text, None, "s", None), (1, text, "en", "s", 5), (3, None, "en", None, None), (4, "", "en", "s", 0), (None, text, "en", "s", 5), (5, "12 ...", "en", "s", 6), (6, "token = abcdefgh and other words", "en", "s", 9)]
    spark.createDataFrame(rows, kinds).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} >= {1, 6} and {2, 3, 4, 5}.isdisjoint(r["doc_id"] for r in out)
    docs = spark.createDataFrame(rows, kinds)
    hidden = {r["doc_id"]: r for r in stages.redact_secrets(spark, docs, str(tmp_path)).collect()}
    assert (hidden[6]["text"], hidden[6]["n_chars"]) == ("[assign] and other words", 24)
    assert len(hidden) == 7 and hidden[3]["text"] is None
    docs = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs, str(tmp_path))
        assert empty.count() == 0
        docs = empty if empty.columns == docs.columns else docs
