"""Encoding, decoding, the token store and fertility, against the libraries and plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sparkloom.llm import binary, bpe, fertility

from .helpers import documents, odd_rows, text

RANKS = public_tokenizers.path(bpe.VOCABULARY)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})


ENCODER = bpe.Encoder.of_ranks(RANKS)
PIECES = ["'", "s", "t", "re", "ve", "ll", "d", "m", " ", "  ", "\n", "\t", " ", "　", "a", "B", "é", "1", "²", "Ⅷ", "!", "$", "-", "日", "😀", "\x1c", "\x85", "'s", "x'll", "́", "word", "٣", "<|endoftext|>"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=25).map("".join) | st.text(max_size=40))
def test_encoder_is_the_librarys(library, t):
    ids, n, _, _ = ENCODER.encode([t, "", t])
    assert ids.tolist() == library.encode_ordinary(t) * 2 and n.tolist() == [len(ids) // 2, 0, len(ids) // 2]


def test_long_slices_and_offsets(library):
    for t in ("a" * 5000, " " * 3000, "'" * 700, "ab" * 3000, "日本" * 500):
        assert ENCODER.encode([t])[0].tolist() == library.encode_ordinary(t)
    t = "It's   a\n\n test, isn't it? 日本 12"
    _, _, starts, counts = ENCODER.encode([t])
    parts = [t[a:b] for a, b in zip(starts.tolist(), [*starts.tolist()[1:], len(t)])]
    import regex

    assert parts == regex.findall(public_tokenizers.PATTERN, t) and counts.tolist() == [len(parts)]


def test_long_texts_go_in_stretches(library, monkeypatch):
    monkeypatch.setattr(bpe, "STRETCH", 50)
    rnd = random.Random(8)
    for n in (0, 40, 200, 3000):
        t = "".join(rnd.choice(PIECES + [" a", " b1"]) for _ in range(n))
        ids, k, starts, counts = ENCODER.encode(["x y", t, ""])
        want = library.encode_ordinary(t)
        assert ids.tolist() == library.encode_ordinary("x y") + want and k.tolist() == [2, len(want), 0]
        import regex

        assert starts[counts[0] :].tolist() == [m.start() for m in regex.finditer(public_tokenizers.PATTERN, t)]


def test_long_texts_without_spaces_are_cut_too():
    t = "".join(chr(0x4E00 + i * 7 % 9000) + ("。" if i % 41 == 0 else "") for i in range(1_900_000))
    parts = list(bpe.Slicer().stretches(t))
    assert "".join(parts) == t and len(parts) >= 4 and max(map(len, parts)) <= bpe.STRETCH


def thue_morse(n):
    """Words that collide under every polynomial hash modulo a power of two."""
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


def test_slices_are_compared_not_only_hashed(library):
    a, b = thue_morse(10)
    for x, y in ((a, b), (a.replace("a", "é"), b.replace("a", "é")), ("x\0", "x\0\0")):
        ids, n, _, _ = ENCODER.encode([x, y, x])
        assert ids.tolist() == library.encode_ordinary(x) + library.encode_ordinary(y) + library.encode_ordinary(x)
        ids, n = WHOLE.encode([x, y])
        assert ids.tolist() == [i for t in (x, y) for i in WHOLE.tokenizer.encode(t, add_special_tokens=False).ids]
        m = METER([f"{x}\n{y}\n{x}\n1 2 3 {x} 4 1 2 3 {y} 4"])
        assert (m["n_dup_lines"][0], m["n_repeat_words"][0]) == (1, 0)


def test_windows_that_share_a_hash_are_counted_apart(monkeypatch):
    words = np.array([1, 2, 3, 4, 5, 9, 1, 2, 3, 4, 5, 7, 8, 6, 5, 4])
    doc = np.zeros(len(words), np.int64)
    assert fertility.repeated_words(words, doc, 1).tolist() == [10]
    monkeypatch.setattr(fertility, "_FACTOR", 0)  # every hash is one
    assert fertility.repeated_words(words, doc, 1).tolist() == [10]


def test_cache_may_be_cleared(library):
    small = bpe.Encoder(ENCODER.cache.merge, bits=4)
    rnd = random.Random(3)
    for _ in range(30):
        t = " ".join(text(rnd.randint(0, 999), 20).split())
        assert small.encode([t])[0].tolist() == library.encode_ordinary(t)


def test_scan_is_associative_over_blocks():
    t = "".join(random.Random(5).choice(PIECES) for _ in range(3000))
    a = bpe.Slicer()
    _, points, begins = bpe.join_texts([t])
    s = a.symbols(points, begins[:1])
    assert all((a.automaton.slice_starts(s, block=b) == a.automaton.slice_starts(s)).all() for b in (1, 2, 7, 64, 5000))


def test_round_trip(spark, library):
    rows = odd_rows()
    d = documents(spark, rows)
    got = bpe.encode(d, decoded=True).collect()
    assert Counter((r["doc_id"], tuple(r["ids"]), bytes(r["decoded"])) for r in got) == Counter((x[0], tuple(library.encode_ordinary(x[1] or "")), (x[1] or "").encode()) for x in rows)
    again = bpe.decode(bpe.encode(d).drop("decoded")).collect()
    assert Counter(bytes(r["decoded"]) for r in again) == Counter((x[1] or "").encode() for x in rows)
    dig = bpe.digests(bpe.encode(d, offsets=False, decoded=True)).collect()
    want = Counter((x[0], len(i := library.encode_ordinary(x[1] or "")), hashlib.sha256(",".join(map(str, i)).encode()).hexdigest()) for x in rows)
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in dig) == want
    assert bpe.decode(bpe.encode(documents(spark, [])).drop("decoded")).count() == 0


# --- the store ---


def test_perfect_hash():
    keys = pa.array([*range(-500, 20_000, 3), None])
    h1, h2 = binary.hash_keys(keys)
    f = binary.PerfectHash.build(h1, h2)
    assert sorted(f.slots(h1, h2).tolist()) == list(range(len(keys)))
    other = binary.hash_keys(pa.array(range(10**6, 10**6 + 5000)))
    there = f.slots(*other)
    assert ((there >= -1) & (there < len(keys))).all()
    assert len(binary.PerfectHash.build(h1[:0], h2[:0]).slots(h1[:3], h2[:3])) == 3


def test_store(spark):
    rows = odd_rows() + [(1000 + i, text(i, i % 60), "en", "a", 1) for i in range(500)]
    d = documents(spark, rows).repartition(5)
    folder, manifest = binary.write(d)
    found = binary.with_starts(binary.checksums(binary.look_up(spark, folder, d)), manifest).collect()
    hf = Tokenizer.from_file(public_tokenizers.path(binary.VOCABULARY))
    hf.encode_special_tokens = True
    ids_of = lambda t: hf.encode(t or "", add_special_tokens=False).ids + [binary.END_ID]
    crc = lambda i: zlib.crc32(np.array(i, "<u4").tobytes())
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in found) == Counter((x[0], len(i := ids_of(x[1])), crc(i)) for x in rows)
    # starts are the running sum in order of key
    at = 0
    for r in sorted(found, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(found, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda k: (k is not None, k or 0))
    store = binary.Store(folder)
    assert store.get(1003)[0].tolist() == ids_of(text(3, 3)) and len(store.get(6)) == 2 and store.get(10**9) == []
    assert binary.look_up(spark, folder, spark.createDataFrame([(10**9,)], "doc_id long")).count() == 0


def test_store_of_texts_with_added_tokens(spark):
    """As the library encodes them, told nothing of special tokens in texts."""
    mark = "<|endoftext|>"
    texts = [f"end{mark}next", mark, f"{mark}{mark} a", f"  {mark}  two  spaces \n {mark}\n", "<|endoftext|", f"<|{mark}|>", f"don{mark}'t", "no mark", "", text(5, 200_000) + mark + text(6, 50)]
    folder, manifest = binary.write(documents(spark, [(i, t, "en", "a", 1) for i, t in enumerate(texts)]))
    hf = Tokenizer.from_file(public_tokenizers.path(binary.VOCABULARY))
    want = [hf.encode(t, add_special_tokens=False).ids + [binary.END_ID] for t in texts]
    assert want[0] == [437, 50256, 19545, binary.END_ID]
    store = binary.Store(folder)
    assert [store.get(i)[0].tolist() for i in range(len(texts))] == want
    found = binary.with_starts(binary.checksums(binary.look_up(spark, folder, documents(spark, [(i, t, "en", "a", 1) for i, t in enumerate(texts)]))), manifest)
    assert [r["start"] for r in found.orderBy("doc_id").collect()] == [sum(map(len, want[:i])) for i in range(len(texts))]


WHOLE = binary._hf(public_tokenizers.path(binary.VOCABULARY))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["<|endoftext|>", "<|", "|>", "endoftext", "a", " b", " ", "\n", "'s", "1", "é", "日"]), max_size=20).map("".join), min_size=1, max_size=4))
def test_whole_texts(texts):
    ids, n = WHOLE.encode(texts)
    want = [WHOLE.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert n.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]


def test_added_tokens_with_conditions():
    from tokenizers import AddedToken

    encoder = binary._hf(public_tokenizers.path(binary.VOCABULARY))
    encoder.tokenizer.add_tokens([AddedToken("<|mark|>", lstrip=True, rstrip=True)])
    encoder = binary.WholeTexts(encoder.encoder, encoder.tokenizer)
    texts = ["a  <|mark|>  b<|endoftext|> c", "plain"]
    want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    ids, n = encoder.encode(texts)
    assert n.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]


def test_store_of_many_files_and_a_hot_key(spark, monkeypatch):
    """Files roll over, a key of many rows takes several ranges, one look-up reads little."""
    import shutil, tempfile  # noqa: E401

    rows = [(i, text(i, 30 + i % 50), "en", "a", 1) for i in range(400)] + [(77, text(i, 40), "en", "a", 1) for i in range(300)] + [(None, "x", "en", "a", 1)] * 40
    d = documents(spark, rows).repartition(3)
    folder, manifest = binary.write(d)
    found = binary.look_up(spark, folder, d).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(r[0] for r in rows)
    assert len({r["shard"] for r in found if r["doc_id"] == 77}) > 1
    store = binary.Store(folder)
    ids_of = lambda t: WHOLE.tokenizer.encode(t, add_special_tokens=False).ids + [binary.END_ID]
    assert store.get(5)[0].tolist() == ids_of(text(5, 35)) and store.bytes < 65536
    assert Counter(tuple(x.tolist()) for x in store.get(77)) == Counter(tuple(ids_of(r[1])) for r in rows if r[0] == 77)
    at = f"file://{tempfile.mkdtemp()}"
    monkeypatch.setattr(binary, "SHARD_BYTES", 64)
    out, want = binary._Payload(at, 3, 2), []
    for i in range(20):
        ids = np.arange(i, 3 * i + 1, dtype=np.uint32)
        out.add(ids, np.array([len(ids)]))
        want.append((out.shard, ids.tolist()))
        if out.full():
            out.close()
    if out.out:
        out.close()
    assert len({n for n, _ in want}) > 3
    for n in {n for n, _ in want}:
        mine = [x for k, x in want if k == n]
        ids, before = binary.Shard(at, n).rows(0, len(mine))
        assert [x.tolist() for x in np.split(ids, before[1:-1])] == mine
    shutil.rmtree(at[7:])


def test_width_of_ids(spark, tmp_path):
    assert binary.largest_id(public_tokenizers.path(binary.VOCABULARY)) == 50256
    out = binary._Payload(f"file://{tmp_path}", 0, 2)
    with pytest.raises(ValueError):
        out.add(np.array([70_000], np.uint32), np.array([1]))
    d = documents(spark, [(1, "some text", "en", "a", 1)])
    wide, _ = binary.write(d, width=4)
    narrow, _ = binary.write(d)
    assert binary.Store(wide).head["width"] == 4 and binary.Store(narrow).head["width"] == 2
    assert binary.Store(wide).get(1)[0].tolist() == binary.Store(narrow).get(1)[0].tolist()
    big, _ = binary.write(d, end_id=70_000)
    assert binary.Store(big).get(1)[0].tolist()[-1] == 70_000


def test_store_of_nothing(spark):
    folder, manifest = binary.write(documents(spark, []))
    assert manifest.count() == 0 and binary.look_up(spark, folder, documents(spark, [])).count() == 0


# --- fertility ---


def brute(t):
    ws = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)]
    c, marked = Counter(grams), set()
    for i, g in enumerate(grams):
        if c[g] > 1:
            marked.update(range(i, i + 5))
    return len(ws), sum(map(len, ws)), sum(t.count(s) for s in fertility.SYMBOLS), dup, len(marked)


METER = fertility.Meter(public_tokenizers.path(fertility.VOCABULARY))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "ab", " ", "  ", "\n", "\r", "\t", "#", "|", "é", "日", " "]), max_size=40).map("".join), min_size=1, max_size=4))
def test_base_measures(texts):
    m = METER(texts)
    got = [tuple(int(m[c][i]) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for i in range(len(texts))]
    assert got == [brute(t) for t in texts]


def test_fertility_of_words():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(fertility.VOCABULARY))
    t = text(4, 200) + " 日本語 \U0001f9ff ꙮ"
    ids = [i for w in t.split() for i in sp.encode(w)]
    m = METER([t])
    counts = np.array(list(Counter(ids).values())) / len(ids)
    assert m["n_tokens"][0] == len(ids) and m["n_bytes"][0] == sum(sp.is_byte(i) for i in ids) > 0
    assert m["entropy"][0] == pytest.approx(float(-(counts * np.log2(counts)).sum()))


def test_fertility_verdict(spark):
    rows = [(i, text(i, 120 + i % 40), "en" if i % 3 else None, "a", 1) for i in range(900)]
    junk = [(5000 + i, " ".join(["ZQXЖꙮ"] * 3 + ["\U0001f9ff%d" % j for j in range(80)]), "en", "a", 1) for i in range(3)]
    got = {r["doc_id"]: r for r in fertility.judge(documents(spark, rows + junk + odd_rows())).collect()}
    assert sum(got[i]["rejected"] for i in range(9, 900)) == 0
    assert all(got[j[0]]["rejected"] and not got[j[0]]["kept"] for j in junk)
    assert got[2]["n_words"] == 0 and got[2]["base_failed"] and got[2]["chars_per_token"] is None
    assert fertility.judge(documents(spark, [])).count() == 0


def test_fertility_of_short_texts_and_small_groups(spark):
    """Texts of under 200 tokens, languages of a few texts and monotonous or overfull ones are judged too."""
    rows = [(i, text(i, 20 + i % 12), "en", "a", 1) for i in range(200)] + [(i, text(i, 120 + i % 40), "en", "a", 1) for i in range(200, 500)]
    few = [(600 + i, text(600 + i, 22), "xx", "a", 1) for i in range(3)]
    odd = "qzxj vkqw xzzq jjkq wqxv zzkj qxqx vvzj kqzw xjqv zqkk wjxz".upper()
    junk = [(700, f"{odd} {odd[::-1]}", "en", "a", 1), (701, " ".join("\U0001f9ff%d" % j for j in range(15)), "xx", "a", 1), (702, " ".join("alpha beta gamma".split() * 60), "en", "a", 1)]
    got = {r["doc_id"]: r for r in fertility.judge(documents(spark, rows + few + junk)).collect()}
    assert got[700]["n_tokens"] < 200 and not got[700]["base_failed"]
    assert {i for i in got if got[i]["rejected"]} == {700, 701, 702}
