"""Token files, quality rules, word-piece counts and shards against plain Python."""

from __future__ import annotations

import io
import json
import random
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.models import WordPiece

from almagest.llm import quality_rules, sharding, token_counts, token_files
from tests.llm.helpers import SCHEMA, WORD, frame, odd_rows, values

BPE = public_tokenizers.path("byte_bpe_50k.json")


def test_tokens_round_trip(spark):
    extra = [(300, "a  b"), (301, " a b "), (302, "a \n b\n\n  c   d"), (303, "it's <|endoftext|> x"), (304, "tab\t x")]
    rows = odd_rows() + extra
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several files from a small table
    try:
        manifest = token_files.write_tokens(frame(spark, rows), BPE, frame_tokens=500)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    read = token_files.read_tokens(manifest)
    assert read.rdd.getNumPartitions() == manifest.count() > 1  # files are read side by side
    got = values(read, "doc_id", "start", "n_tokens", "ids_crc32")
    tokenizer, expected, start = Tokenizer.from_file(BPE), [], 0
    for d, t in sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode())):
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 2]
        expected.append((d, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    assert got == sorted(expected, key=repr)


def test_pieces_have_the_ids_of_the_library():
    """Any mix of signs, white space, contractions and letters that the cuts don't know."""
    rng = random.Random(8)
    parts = [*"ab zé''s.t,r e\n\t\r  01'llvemd×÷ñ漢—’\u00a0\u0085\x0b\x1c\x00\u0301²½Ⅷ٣жЯſß_^|#😀\u3000\u200d", "'re", " '", "  ", "\n\n", "x" * 50, "<|endoftext|>"]
    texts = ["".join(rng.choices(parts, k=rng.choice([0, 1, 2, 5, 20, 60]))) for _ in range(6_000)]
    coder, library = token_files.Encoder(BPE), Tokenizer.from_file(BPE)
    assert coder.by_pieces
    got = [data for k in range(0, len(texts), 500) for data in coder.encode(pa.array(texts[k : k + 500]))]
    assert got == [np.array(e.ids, dtype="<u2").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]


def test_pieces_are_few_and_encoded_once():
    texts = [f"word{k % 7},\nother{k % 5}. {k % 3} it's\tit" for k in range(3_000)]
    coder = token_files.Encoder(BPE)
    passed = []
    whole = coder.whole
    coder.whole = lambda pieces: passed.extend(pieces) or whole(pieces)
    for _ in range(2):
        assert len(list(coder.encode(pa.array(texts)))) == 3_000
    assert len(passed) == len(set(passed)) <= 25  # of 39 words between spaces


def test_other_tokenizers_take_whole_texts(tmp_path):
    other = json.loads(Path(BPE).read_text())
    other["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "other.json").write_text(json.dumps(other))
    coder, texts = token_files.Encoder(str(tmp_path / "other.json")), ["one two", "", "it's\n\n x"]
    assert not coder.by_pieces
    expected = [np.array(e.ids, dtype="<u2").tobytes() for e in Tokenizer.from_file(str(tmp_path / "other.json")).encode_batch(texts, add_special_tokens=False)]
    assert list(coder.encode(pa.array(texts))) == expected


def test_tokens_of_an_empty_table(spark):
    manifest = token_files.write_tokens(spark.createDataFrame([], SCHEMA), BPE)
    assert token_files.read_tokens(manifest).count() == 0


def test_reader_opens_only_the_frames_it_needs():
    documents = [(i, np.arange(i, i + n, dtype="<u2").tobytes()) for i, n in enumerate([10, 0, 2_000, 5, 990, 1])]
    out = io.BytesIO()
    assert token_files.write_file(out, documents, width=2, frame_tokens=1_000) == (6, 3_006)
    data = out.getvalue()
    file = token_files.TokenFile(io.BytesIO(data), len(data))
    [(doc, ids)] = file.documents([4])
    assert (doc, ids.tolist(), file.frames_read) == (4, list(range(4, 994)), 1)
    assert [(d, i.tobytes()) for d, i in file.documents()] == documents


def test_reader_finds_damage():
    out = io.BytesIO()
    token_files.write_file(out, [(1, bytes(range(200)) * 20)], width=2)
    data = bytearray(out.getvalue())
    file = token_files.TokenFile(io.BytesIO(bytes(data)), len(data))
    data[20] ^= 0xFF
    file.source = io.BytesIO(bytes(data))
    with pytest.raises(Exception):
        list(file.documents())
    with pytest.raises(ValueError):
        token_files.TokenFile(io.BytesIO(bytes(data[:-4])), len(data) - 4)


def plain_statistics(text):
    words = WORD.findall(text or "")
    triples = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + j for i in range(len(words) - 2) if triples[tuple(words[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_statistics(spark):
    rows = odd_rows()
    out, s = quality_rules.judged(frame(spark, rows).withColumn("quality_stats", F.lit(1)), [])
    assert s != "quality_stats" and "quality_stats" in out.columns
    names = [f"{s}.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")]
    expected = []
    for d, t in rows:
        stats = plain_statistics(t)
        failed = stats[0] < 50 or 100 * stats[4] > 50 * stats[0]
        expected.append((d, *stats, failed, not failed))
    assert values(out, "doc_id", *names) == sorted(expected, key=repr)


def test_rules_are_learned_and_leave_good_rows(spark):
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(300):
        words = [f"w{rng.integers(10**6)}" for _ in range(80)]
        bad = i % 3 == 0
        rows.append((i, " ".join(w + "###" if bad else w for w in words)))
        labels.append((i, 0 if bad else 1))
    labels += [(1, 0), (None, 0), (2, None)]  # a contradiction and nulls
    docs, table = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int")
    rules = quality_rules.fit(docs, table)
    assert rules and all(0 < len(r) <= 5 for r in rules)
    kept = {r.doc_id for r in quality_rules.keep_good(docs, table, rules).collect()}
    assert kept == {i for i in range(300) if i % 3}
    assert quality_rules.keep_good(docs, table, rules).columns == docs.columns
    assert quality_rules.fit(docs, table.where("quality = 1")) == []
    assert quality_rules.fit(docs.limit(0), table) == []


def test_word_pieces(spark):
    rows = odd_rows()
    got = values(token_counts.with_counts(frame(spark, rows), BPE), "doc_id", "n_words", "n_tokens", "n_unknown")
    letters = {b: c for c, b in token_counts.byte_alphabet().items()}
    with open(BPE, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    pieces: dict[str, int] = {}
    for p in vocabulary:
        pieces.setdefault(p[1:] if p[0] == letters[0x20] else " " + p, len(pieces))
    pieces = {p: i for i, p in enumerate(p for p in [*pieces, "[UNK]"] if p not in ("", " "))}
    # no byte is written as a space, so no word looks like a continuing piece
    model = WordPiece(pieces, unk_token="[UNK]", max_input_chars_per_word=10**6, continuing_subword_prefix=" ")

    def split_long(word):
        """The model's rule; the model itself takes time in the square of a word's length."""
        out, at = [], 0
        while at < len(word):
            size = next((n for n in range(min(300, len(word) - at), 0, -1) if " " * bool(at) + word[at : at + n] in pieces), 0)
            if not size:
                return ["[UNK]"]
            out.append(word[at : at + size])
            at += size
        return out

    assert max(map(len, pieces)) < 300
    expected = []
    for d, t in rows:
        words = WORD.findall(t or "")
        spelled = ["".join(letters[b] for b in w.encode()) for w in words]
        split = [split_long(w) if len(w) > 1_000 else [p.value for p in model.tokenize(w)] for w in spelled]
        unknown = sum(s[0] == "[UNK]" for s in split)
        expected.append((d, len(words), sum(map(len, split)), unknown))
    assert got == sorted(expected, key=repr)


def test_automaton_against_greedy_search():
    first, rest = [b"a", b"ab", b"abcd", b"b"], [b"b", b"c", b"cd", b"bcd", b"d"]
    automaton = token_counts.LongestMatch(first, rest)

    def greedy(word):
        n, at = 0, 0
        while at < len(word):
            options = [p for p in (rest if n else first) if word.startswith(p, at)]
            if not options:
                return 0
            at += len(max(options, key=len))
            n += 1
        return n

    for n in range(1, 7):
        for code in range(4**n):
            word = bytes(b"abcd"[code // 4**i % 4] for i in range(n))
            assert automaton.count(word) == greedy(word), word


def test_shards_are_even_and_gapless(spark):
    rows = odd_rows() + [(1000 + i, "hot") for i in range(60)] + [(7, "hot"), (7, "hot")]
    out = sharding.shard(frame(spark, rows), 5, nodes=8, bits=8, group_rows=4).collect()
    assert len(out) == len(rows)
    slots: dict[int, list[int]] = {}
    for r in out:
        slots.setdefault(r.shard, []).append(r.slot)
        raw = (r.text or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "rows", None)
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sharding.places(spark.createDataFrame([], SCHEMA), 5).count() == 0


def test_ring_keeps_most_rows_when_a_shard_is_added():
    rng = np.random.default_rng(2)
    counts = {int(c): int(rng.integers(1, 4)) for c in rng.choice(4096, 2_000, replace=False)}

    def homes(shards):
        return {(cell, r): s for cell, a, b, s, _ in sharding.assign(counts, shards, nodes=64, bits=12) for r in range(a, b)}

    before, after = homes(10), homes(11)
    moved = sum(before[k] != after[k] for k in before) / len(before)
    assert len(before) == sum(counts.values()) and moved < 0.35
