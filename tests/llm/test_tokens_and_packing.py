import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from keyloom.llm import packing, tokens
from keyloom.llm.shared import new_folder

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", None, "  \n", "Å H̱ x", "<|endoftext|> Hi<|startoftext|>", "it's DON'T we'LL, 'tis", "Σας ΟΔΟΣ ΟΔΟΣ, İx ẞ", "a b c\u0085d", "x!!y ,. ...a (a), [b]; 12,34.5", "日本語テキスト、です。", "ﬁ ½ Ⅳ ​ z", "é É ́a a ̈", "same text", "same text", "ÿ÷x× µm ß", "long " * 30_000 + "end. x###", "a word of sixty-four-or-more-bytes-" + "x" * 60 + " End\u00a0nbsp \u3000 ideographic"]
THUE = ["a", "b"]
for _ in range(11):  # two words that no polynomial hash modulo 2**64 tells apart
    THUE = [THUE[0] + THUE[1], THUE[1] + THUE[0]]
ODD.append(f"{THUE[0]} {THUE[1]} {THUE[0]}")


TOKENIZER = Tokenizer.from_file(PATH)


def direct(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 2]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(None if i == 3 else min(i, 12), t, i) for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids int").repartition(3)


def test_token_files_round_trip(spark, docs):
    path = new_folder(spark, "test-tokens")
    manifest = tokens.write_tokens(docs, path, PATH, 2)
    got = tokens.read_tokens(spark, path).orderBy("start").collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, bytes(r.ids)) for r in got) == sorted((i != 3, 0 if i == 3 else min(i, 12), np.array(direct(t), "<u4").tobytes()) for i, t in enumerate(ODD))
    keys = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert keys == sorted(keys)
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    assert sum(s["ids"] for s in manifest["shards"]) == sum(r.n_tokens for r in got)


def test_token_files_of_nothing(spark, docs):
    path = new_folder(spark, "test-tokens")
    assert tokens.write_tokens(docs.limit(0), path, PATH, 2)["shards"] == []
    assert tokens.read_tokens(spark, path).count() == 0


@pytest.mark.parametrize("limits", [(4096, 512, 4096), (64, 3, 40), (7, 1, 7)])
def test_packing_places_each_id_once(docs, limits):
    rows = packing.pack(docs, PATH, 2, *limits).collect()
    whole, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        whole[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
        assert len(r.ids) == 4 * r.length
    want = defaultdict(list)
    for i, t in enumerate(ODD):
        want[None if i == 3 else min(i, 12)].append(direct(t))
    for doc, found in whole.items():
        assert sum(r.length for r in found) == sum(map(len, want[doc]))
        if len(want[doc]) == 1:
            ids = b"".join(bytes(r.ids) for r in sorted(found, key=lambda r: r.start))
            assert ids == np.array(want[doc][0], "<u4").tobytes()
            assert {r.doc_tokens for r in found} == {len(want[doc][0])}
    padding = 0
    for found in sequences.values():
        found.sort(key=lambda r: r.offset)
        assert [r.offset for r in found] == np.cumsum([0, *(r.length for r in found)])[:-1].tolist()
        used = sum(r.length for r in found)
        assert used <= limits[0] and len(found) <= limits[1] and sum(r.loss_tokens for r in found) <= limits[2]
        padding += 0 if used & (used - 1) == 0 else limits[0] - used
    assert padding == 0


def test_packing_with_prompts(spark):
    rows = spark.createDataFrame([(i, "one two three four " + "answer " * (i % 7), 18) for i in range(50)], "doc_id long, text string, n int")
    out = packing.pack(rows, PATH, 2, 40, 8, 12, prompt_chars_col="n").groupBy("sequence_id").agg({"loss_tokens": "sum", "length": "sum"}).collect()
    assert all(r[1] <= 12 or r[2] <= 12 for r in out) and sum(r["sum(length)"] for r in out) == sum(5 + i % 7 for i in range(50))


def test_encoder_equals_the_library_on_the_whole_table(spark):
    from keyloom.llm.encoding import Encoder

    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").collect()]
    encoder = Encoder(PATH, 2)
    assert encoder.by_words
    found = encoder.encode([t.encode() for t in texts])
    for a in range(0, len(texts), 1000):
        for want in TOKENIZER.encode_batch_fast(texts[a : a + 1000], add_special_tokens=False):
            assert next(found).tolist() == [*want.ids, 2]


def test_words_whose_hashes_meet_keep_their_own_ids(monkeypatch):
    from keyloom.llm import encoding, textbatch

    plain = textbatch.TextBatch._hashed
    monkeypatch.setattr(textbatch.TextBatch, "_hashed", lambda self, *a: plain(self, *a) & np.uint64(7))
    encoder = encoding.Encoder(PATH, 2)
    texts = ["one two three four five six seven eight nine ten", "ten nine eleven twelve one thirteen " * 3]
    for _ in range(2):
        assert [x.tolist() for x in encoder.encode([t.encode() for t in texts])] == [direct(t) for t in texts]


def test_packing_of_nothing(docs):
    assert packing.pack(docs.limit(0), PATH, 2).count() == 0


def test_queries_over_documents(spark):
    from keyloom.llm import queries

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    start = 0
    for r in queries.op1_token_files(spark, sf).orderBy("doc_id").collect():
        ids = np.array(direct(texts[r.doc_id]), "<u4").tobytes()
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids) // 4, zlib.crc32(ids))
        start += r.n_tokens
    assert sum(r.length for r in queries.op9_vector_packing(spark, sf).collect()) == start


def test_new_words_enter_the_store_in_few_steps(monkeypatch):
    """Each step copies the store, so 2 MB of texts with new words throughout are one step, or two."""
    from keyloom.llm.encoding import Encoder

    encoder, steps, learn = Encoder(PATH, 2), [], Encoder._learn
    monkeypatch.setattr(Encoder, "_learn", lambda self, *new: (steps.append(1), learn(self, *new)))
    texts = [" ".join(f"w{i}x{k}" for k in range(5_000)).encode() for i in range(40)]
    texts = [t for i, t in enumerate(texts) if sum(map(len, texts[: i + 1])) < 2_000_000]
    assert sum(map(len, texts)) > 1_500_000
    got = list(encoder.encode(texts))
    assert len(steps) <= 2
    assert all(np.array_equal(g, direct(t.decode())) for g, t in zip(got, texts, strict=True))


def test_packing_encodes_in_large_batches(spark, monkeypatch):
    """As above, for the texts that a packing task gets."""
    import pyarrow as pa

    from keyloom.llm.encoding import Encoder

    class Task:
        get = classmethod(lambda cls: cls)
        partitionId = staticmethod(lambda: 0)

    steps, learn = [], Encoder._learn
    monkeypatch.setattr(Encoder, "_learn", lambda self, *new: (steps.append(1), learn(self, *new)))
    monkeypatch.setattr(packing, "TaskContext", Task)
    monkeypatch.setattr(packing, "in_batches", lambda rows, run, schema: run)
    run = packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH, 2)
    texts = [" ".join(f"p{i}x{k}" for k in range(5_000)) for i in range(40)]
    texts = [t for i, t in enumerate(texts) if sum(map(len, texts[: i + 1])) < 2_000_000]
    Encoder._kept.clear()
    record = pa.RecordBatch.from_pydict({"doc": list(range(len(texts))), "prompt": [""] * len(texts), "text": texts})
    out = pa.Table.from_batches(run(iter([record]))).sort_by([("doc_id", "ascending"), ("start", "ascending")])
    assert len(steps) <= 3  # one of them is the probe of a new encoder
    assert np.array_equal(np.frombuffer(b"".join(out["ids"].to_pylist()), "<u4"), np.concatenate([direct(t) for t in texts]))


def test_new_words_are_joined_for_the_library(monkeypatch):
    from keyloom.llm.encoding import Encoder

    encoder, texts, plain = Encoder(PATH, 2), [], Encoder._direct
    monkeypatch.setattr(Encoder, "_direct", lambda self, found: (texts.extend(found), plain(self, found))[1])
    words = [f"{w}{k}" for k in range(100) for w in ("Word", "x,y", "é", "́", "ΟΔΟΣ", " ", "'s", "'", "...", "日本")]
    assert next(encoder.encode([" ".join(words).encode()])).tolist() == direct(" ".join(words))
    assert len(texts) < len(words) / 20


@pytest.mark.parametrize("odd", ["a<|endoftext|>b", "<|endoftext|>", "<|startoftext|>", "<|endoftext", "|>"])
@pytest.mark.parametrize("mark", [True, False])
def test_words_with_the_joining_token_keep_their_ids(odd, mark):
    from keyloom.llm.encoding import Encoder

    encoder = Encoder(PATH, 2)
    encoder.mark = encoder.mark if mark else None
    words = ["one", odd, "two", "three's"]
    ids, size = encoder._apart(words)
    assert [x.tolist() for x in np.split(ids, np.cumsum(size)[:-1])] == [direct(w)[:-1] for w in words]
