"""Word arrays against the library, very long words, and what the written ORC files hold."""

import random
import time
from pathlib import Path

import public_tokenizers
from tokenizers import Tokenizer

from lintlake.llm import token_files
from lintlake.llm.bpe import Encoder
from lintlake.llm.library_tokens import LibraryEncoder
from lintlake.llm.words import WordIds

WORD, BYTE = (public_tokenizers.path(f) for f in ("word_bpe_49k.json", "byte_bpe_50k.json"))
BAG = ["word", " ", "  ", "\n", "\n\n", " \n", "\t", "'s", "'", "don't", "l'été", "Éa", "12", "3½", "²", "“hi”", "—", "日本", "　", "İ", "ß", "Σας", "!?", "<|endoftext|>", "<|", "|>", "\x1c", "\x85", "\xa0", "​", " ", "😀", "ǅ", "ª", "µ", "1.5", "ͅ", "é", "'LL", ""]


def test_mixed_texts_equal_the_library():
    rng = random.Random(5)
    texts = ["".join(rng.choices(BAG, k=rng.randint(0, 14))) for _ in range(3_000)]
    for path in (WORD, BYTE):
        want = [x.ids for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
        assert list(Encoder(path).encode(texts)) == want
        assert [memoryview(x).cast("I").tolist() for x in LibraryEncoder(path).encode(texts)] == want


def test_a_word_of_a_million_letters():
    rng = random.Random(1)
    text = "".join(rng.choices("abcdefghijklmnopqrst", k=1_000_000))
    for path in (WORD, BYTE):
        began = time.monotonic()
        ids = next(iter(Encoder(path).encode([text])))
        assert time.monotonic() - began < 60
        assert ids == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_forgotten_words_are_encoded_again():
    met, asked = WordIds(4), []

    def ids(words):
        def encode(new):
            asked.extend(words[i] for i in new)
            return [[len(words[i]), ord(words[i][0])] for i in new]

        return met.ids(met.places(words, encode))[0].tolist()

    for words in (["a", "bb"], ["ccc", "d", "ee"], ["ee", "f"], ["a", "ee"], []):
        assert ids(words) == [x for w in words for x in (len(w), ord(w[0]))]
    assert asked == ["a", "bb", "ccc", "d", "ee", "f", "a"] and len(met.known) <= 5


def test_files_have_stripes_row_indexes_and_bloom_filters(spark, tmp_path):
    docs = spark.range(12_000).selectExpr("id as doc_id", "concat_ws(' ', transform(sequence(0, 40), k -> sha2(cast(id * 41 + k as string), 256))) as text")
    path = f"{tmp_path}/tokens"
    token_files.write_tokens(docs, path, BYTE, 2, stripe_bytes=1 << 18)
    orc, conf = spark._jvm.org.apache.orc, spark._jsc.hadoopConfiguration()
    stripes = 0
    for file in Path(path).glob("*.orc"):
        reader = orc.OrcFile.createReader(spark._jvm.org.apache.hadoop.fs.Path(str(file)), orc.OrcFile.readerOptions(conf))
        assert reader.getRowIndexStride() == 1_000
        rows = reader.rows()
        for stripe in reader.getStripes():
            stripes += 1
            footer = rows.readStripeFooter(stripe)
            kinds = [(s.getKind().toString(), s.getColumn()) for s in footer.getStreamsList()]
            assert ("BLOOM_FILTER_UTF8", 1) in kinds and ("ROW_INDEX", 1) in kinds
            assert footer.getColumns(1).getKind().toString() == "DIRECT_V2"  # run-length encoded integers
        rows.close()
    assert stripes > 4
    assert token_files.read_tokens(spark, path).where("doc_id = 77").count() == 1
