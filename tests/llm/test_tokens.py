"""Token files, packing and the BPE codec against the libraries, document by document."""

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from scorewatch.llm import bpe_codec, packing, token_files, tokenizing

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = [
    "a  b", " x ", "\n\n a", "foo 's it's", "don't stop's", "a\t\tb", " ", " \n ", "αβ word", "word́ x", "12 34,56.7",
    "<|endoftext|> x", "a <|endoftext|> b", "<|startoftext|>", "<|ENDOFTEXT|>", "lines of\nwords, here;\nend ", " lead", "\n", "it's a b' c", "l'été.  Où? à", "a,b;c!d", "a\x85b　c", "\x1c sep\x1d", "🙂🙂 ok", "tab\tword, \nnew", "ABC 'S x' s",
    "ver  \n  y. ", "éa zß.ǅ ﬁ", "ÀÉÖØÞ Ÿ ß×÷ ÇA, ÀB.", "MiXeD Cc.\nThe the", "x" * 300, "the cat " * 400,
]
ROWS = [(i, t, "z") for i, t in enumerate(ODD)] + [(100, None, "z"), (101, "", "z"), (7, ODD[7], "z"), (None, "no id", None)]
SCHEMA = "doc_id long, text string, ids string"


def _reference(path):
    t = Tokenizer.from_file(path)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_ids_equal_those_of_whole_texts(path):
    want = _reference(path)
    for text in ODD:
        assert tokenizing.encode(path, [text])[0].tolist() == want(text)


@pytest.mark.parametrize("size", [1, 3, 8])
def test_pieces_change_no_ids(size):
    want = _reference(BYTES)
    for text in ODD:
        parts = list(tokenizing.pieces(text, size))
        assert "".join(parts) == text
        assert [i for p in parts for i in want(p)] == want(text)


def test_memo_that_overflows(monkeypatch):
    monkeypatch.setattr(tokenizing, "MEMO_UNITS", 3)
    want = _reference(WORDS)
    texts = ["one two three four five", "two six one seven", "one two " + "y" * 100]
    assert [x.tolist() for x in tokenizing.encode(WORDS, texts)] == [want(t) for t in texts]


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_words_with_any_marks_behind_share_the_words_ids(path):
    """The word goes to the merges alone and is kept; only the marks are analysed."""
    want = _reference(path)
    encoder = tokenizing._Encoder(path)
    units = ["heat***", "are.%%%", " the&&", "x_", 'y")', "l'a", "z's", "b-", "Ab#$%|<>"]
    if encoder.lower:
        units = [u.strip().lower() for u in units]
    got = encoder.new_ids(set(units))
    assert {u: np.frombuffer(got[u], "<u4").tolist() for u in units} == {u: want(u) for u in units}
    assert {"heat", "are", "***", ".%%%"} <= set(encoder.units.young)


def test_texts_together_keep_each_texts_ids(monkeypatch):
    """All texts of a call share their words; white space that a cut would split sends a text to the library."""
    want, rng = _reference(BYTES), np.random.default_rng(5)
    bits = ["a", "Heat", "heat,", "l'", "'s", "été", "ßµª", "x.", "!?", "12", "à-b", "€", "🙂.", "\n", "\n", " ", " ", " ", " ", " ", "\t", "\r", "\x0b"]
    texts = ["".join(rng.choice(bits[:int(rng.integers(15, len(bits) + 1))], rng.integers(0, 30))) for _ in range(3000)] + ODD
    assert [x.tolist() for x in tokenizing.encode(BYTES, texts)] == [want(t) for t in texts]
    monkeypatch.setattr(tokenizing, "PIECE_CHARS", 20)
    assert [x.tolist() for x in tokenizing.encode(BYTES, texts)] == [want(t) for t in texts]


def test_words_are_looked_up_once_a_call_and_new_ones_merged_in_few_calls(monkeypatch):
    encoder, want = tokenizing._Encoder(BYTES), _reference(BYTES)
    looked, merges = [], encoder.merges
    parts = encoder.words.parts
    monkeypatch.setattr(encoder.words, "parts", lambda units: looked.append(list(units)) or parts(units))

    class Counted:
        calls = 0

        def encode_batch_fast(self, texts, **options):
            Counted.calls += 1
            return merges.encode_batch_fast(texts, **options)

    monkeypatch.setattr(encoder, "merges", Counted())
    monkeypatch.setattr(tokenizing, "_encoder", lambda path: encoder)
    texts = [" ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(k, k + 300)) + "\nthe cat, the cat." for k in range(40)]
    assert [x.tolist() for x in tokenizing.encode(BYTES, texts)] == [want(t) for t in texts]
    assert len(looked[0]) == len(set(looked[0])) < 500 and Counted.calls <= 2


def test_lower_case_words_are_looked_up_once_a_call(monkeypatch):
    """Every occurrence was looked up, and words with marks behind went through a pattern."""
    asked, parts = [], tokenizing._Memo.parts

    def counted(memo, units):
        asked.append(len(units))
        return parts(memo, units)

    reference = _reference(WORDS)
    texts = ["The cat, Über alle;\n saß ªº µm Don't... x1 " * 30 + f"end{chr(97 + i)}" for i in range(20)] + ["", "  ", " \r\n a \t", "Ÿ ß", *ODD]
    want = [reference(t) for t in texts]
    monkeypatch.setattr(tokenizing._Memo, "parts", counted)
    tokenizing._encoder.cache_clear()
    assert [x.tolist() for x in tokenizing.encode(WORDS, texts)] == want
    assert sum(asked) < 600  # 30 times 20 texts have some 6,000 words


def test_streams_packed_together_are_those_packed_alone():
    rng = np.random.default_rng(4)
    streams = [(2 ** rng.uniform(0, 32, n)).astype(np.uint32) for n in (1, 0, 4, 5, 300, 3)]
    control, data, sizes = token_files.pack_streams(np.concatenate(streams), [len(x) for x in streams])
    alone = [token_files.pack(x) for x in streams]
    assert control == b"".join(c for c, _ in alone) and data == b"".join(d for _, d in alone) and sizes.tolist() == [len(d) for _, d in alone]
    assert token_files.unpack(control, data, [len(x) for x in streams]).tolist() == np.concatenate(streams).tolist()


def test_codes_of_any_width():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 4, 5, 999):
        v = (rng.integers(0, 2**32, n) >> rng.integers(0, 32, n)).astype(np.uint32)
        control, data = token_files.pack(v)
        assert len(control) == -(-n // 4)
        assert (token_files.unpack(control, data, [n]) == v).all()
        assert (token_files.unpack(control * 2, data * 2, [n, n]) == np.concatenate([v, v])).all()


def test_token_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_TOKENS", 50)
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    token_files.write_token_files(docs, str(tmp_path / "f"), WORDS, end_id=1)
    got = token_files.with_crc(token_files.read_token_files(spark, str(tmp_path / "f"))).collect()
    want_ids = _reference(WORDS)
    want = {}
    for doc, text, _ in ROWS:
        ids = np.array(want_ids(text) + [1], "<u4")
        want[doc] = (len(ids), zlib.crc32(ids.tobytes()))
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in got) == sorted(
        (str(d), *want[d]) for d, _, _ in ROWS)
    ordered = sorted(got, key=lambda r: r["start"])
    assert [-1 if r["doc_id"] is None else r["doc_id"] for r in ordered] == sorted(-1 if d is None else d for d, _, _ in ROWS)
    ends = np.cumsum([r["n_tokens"] for r in ordered])
    assert [r["start"] for r in ordered] == [0, *ends[:-1]]


def test_token_files_of_no_documents(spark, tmp_path):
    token_files.write_token_files(spark.createDataFrame([], SCHEMA), str(tmp_path / "f"), WORDS, end_id=1)
    assert token_files.read_token_files(spark, str(tmp_path / "f")).collect() == []


def _packed(rows, docs, length):
    """Checks every law of a packing; returns the number of sequences."""
    want_ids = _reference(BYTES)
    want = []
    for doc, text in docs:
        ids = np.array(want_ids(text) + [0], "<u4")
        first = len(ids) % length or length
        cuts = [0, *range(first, len(ids), length), len(ids)]
        want += [(doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=key) == sorted(want, key=key)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in sequences.values():
        spans.sort()
        assert [o for o, _ in spans] == [0, *np.cumsum([n for _, n in spans])[:-1]]
        assert sum(n for _, n in spans) <= length
    return len(sequences)


@pytest.mark.parametrize("length", [16, 64, 2048])
def test_packing(spark, length):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    _packed(packing.pack_documents(docs, BYTES, 0, length).collect(), [(d, t) for d, t, _ in ROWS], length)


def test_packing_many_equal_small_documents(spark):
    docs = [(i, "a b c d e f g h i") for i in range(700)] + [(1000 + i, "w " * (i * 13 % 97)) for i in range(300)]
    rows = packing.pack_documents(spark.createDataFrame(docs, "doc_id long, text string"), BYTES, 0, 128).collect()
    tokens = sum(r["length"] for r in rows)
    assert _packed(rows, docs, 128) <= 1.05 * -(-tokens // 128) + 1


def test_packing_no_documents(spark):
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA), BYTES, 0).collect() == []


def test_match_round_gives_each_item_the_tightest_gap_left(spark):
    rng = np.random.default_rng(2)
    items = [(i, int(x)) for i, x in enumerate(rng.integers(1, 40, 150))]
    gaps = [(1000 + i, int(x)) for i, x in enumerate(rng.integers(1, 40, 120))]
    got = packing.match_round(
        spark.createDataFrame(items, "item long, length long"), spark.createDataFrame(gaps, "bin long, gap long")).collect()
    stack, want = [], {}
    for value, kind, key in sorted([(-v, 1, k) for k, v in items] + [(-v, 0, k) for k, v in gaps]):
        if kind == 0:
            stack.append((key, -value))
        elif stack:
            want[key] = stack.pop()
    assert {r["id"]: (r["other_id"], r["other_value"]) for r in got if r["kind"] == 1 and r["other_id"] is not None} == want
    assert {r["other_id"] for r in got if r["kind"] == 0 and r["other_id"] is not None} == set(want)
    assert len(got) == len(items) + len(gaps)


def test_codec(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = ROWS + [(500, "long words and lines.\n" * 20000, None)]
    tokens = bpe_codec.encode_texts(spark.createDataFrame(rows, SCHEMA), RANKS, public_tokenizers.PATTERN)
    got = bpe_codec.decode_ids(tokens, RANKS, public_tokenizers.PATTERN).withColumn("digest", bpe_codec.ids_sha256("ids")).collect()
    assert len(got) == len(rows)
    texts = {d: t or "" for d, t, _ in rows}
    for r in got:
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert r["ids"] == ids
        assert r["digest"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert bytes(r["decoded"]) == texts[r["doc_id"]].encode()


def test_codec_decodes_bytes_that_are_no_text(spark):
    ids = bpe_codec.encoding(RANKS, public_tokenizers.PATTERN).encode_ordinary("🙂")[:1]
    got = bpe_codec.decode_ids(spark.createDataFrame([(1, ids), (2, None)], "doc_id long, ids array<int>"), RANKS, public_tokenizers.PATTERN)
    assert {r["doc_id"]: bytes(r["decoded"]) for r in got.collect()}[2] == b""


def test_long_white_space_is_one_match(spark):
    texts = [" " * 1_000_000 + "word", "a" + "\n" * 2_000_000, "é \t" + " " * 150_000 + "x y", "　" * 120_000, " " * 300_000]
    codec = bpe_codec.encoding(RANKS, public_tokenizers.PATTERN)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = bpe_codec.decode_ids(bpe_codec.encode_texts(docs, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN).collect()
    assert {r["doc_id"]: bytes(r["decoded"]).decode() for r in got} == dict(enumerate(texts))
    ids = {r["doc_id"]: r["ids"] for r in got}
    for i in (2, 3, 4):  # the library can do these whole
        assert ids[i] == codec.encode_ordinary(texts[i])


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_parts_change_no_ids(longest):
    codec = bpe_codec.encoding(RANKS, public_tokenizers.PATTERN)
    for text in [*ODD, "a   b", "   ", "\n\n\nx", "x 　 1", "a \x85 's", "  'll"]:
        parts = list(bpe_codec.parts_of(text, max(2, longest)))
        assert "".join(p for _, p in parts) == text
        ids = [i for space, p in parts for i in (codec._encode_single_piece(p.encode()) if space else codec.encode_ordinary(p))]
        assert ids == codec.encode_ordinary(text)


def test_codec_of_no_documents(spark):
    tokens = bpe_codec.encode_texts(spark.createDataFrame([], "doc_id long, text string"), RANKS, public_tokenizers.PATTERN)
    assert bpe_codec.decode_ids(tokens, RANKS, public_tokenizers.PATTERN).collect() == []


def test_codec_query_holds_one_python_stage_at_a_time(spark, tmp_path):
    """Encoding and decoding ran in one stage, so each core had two workers and their batches."""
    from scorewatch.llm.queries import op10_bpe_codec

    rows = [(i, t) for i, t in enumerate(ODD)] + [(100, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = op10_bpe_codec(spark, str(tmp_path))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    codec = bpe_codec.encoding(RANKS, public_tokenizers.PATTERN)
    for r in got.collect():
        text = dict(rows)[r["doc_id"]] or ""
        assert r["ids_sha256"] == bpe_codec.digest(codec.encode_ordinary(text))
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
