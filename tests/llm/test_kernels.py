"""Kernels without Spark: tokens, signatures, automata, JPEG, ZIP, HTML, suffix arrays."""

import collections
import io
import random
import re
import zipfile

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from meshlight.llm import jpeg, secrets, warc
from meshlight.llm.automaton import Automaton
from meshlight.llm.decontaminate import Block, Shard, suffix_array
from meshlight.llm.html import extract
from meshlight.llm.media import feature, padded
from meshlight.llm.minhash import bag, overlap, shingles, signatures
from meshlight.llm.tokens import chunks, code_points, span_hash, split_words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@given(st.lists(st.one_of(st.none(), st.text()), max_size=6))
@settings(max_examples=60, deadline=None)
def test_words_are_those_of_the_pattern(texts):
    texts = [t.encode("utf-8", "ignore").decode() if t else t for t in texts]
    for t in chunks(pa.array(texts, pa.string()), 8):
        words, folded = split_words(t)
        for i in range(len(t.start)):
            a, b = words.first[i], words.first[i + 1]
            got = [folded[x:y].tobytes().decode() for x, y in zip(words.start[a:b], words.end[a:b], strict=True)]
            assert got == WORD.findall((texts[t.lo + i] or "").translate(FOLD))


def hashes(texts):
    t = next(chunks(pa.array(texts), 1 << 30))
    words, folded = split_words(t)
    return span_hash(folded, words.start, words.end), words


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(5)
    items = rng.integers(1, 1 << 60, 200).astype(np.uint64)
    a, b = rng.integers(0, 20, 200), rng.integers(0, 20, 200)
    h = np.concatenate([items[a > 0], items[b > 0]])
    doc = np.repeat([0, 1], [(a > 0).sum(), (b > 0).sum()])
    sig = signatures(h, doc, np.concatenate([a[a > 0], b[b > 0]]), 2, 4096)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((sig[0] == sig[1]).mean() - want) < 0.03
    assert np.isfinite(sig).all()


def test_overlap_is_exact():
    a, b = "a b c d e f a b c d e", "a b c d e f g"
    shing = lambda t: collections.Counter(tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4))
    x, y = shing(a), shing(b)
    want = sum((x & y).values()) / sum((x | y).values())
    assert overlap(pa.array([a, "", "q"]), pa.array([b, "", "q"]), 5).tolist() == [want, 0.0, 1.0]


def test_short_texts_are_one_shingle():
    h, words = hashes(["one two", "", "a b c d e f"])
    _, doc = shingles(h, words.first, 5)
    assert doc.tolist() == [0, 2, 2]
    assert len(bag(np.zeros(0, np.uint64), np.zeros(0, int))[0]) == 0


def test_suffix_array_and_windows():
    rng = random.Random(2)
    docs = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) for _ in range(30)]
    items = [" ".join(rng.choice("abc") for _ in range(n)) for n in (1, 3, 4, 5, 9)] + ["", "zz"]
    names = [str(i) for i in range(len(items))]
    h, words = hashes(docs)
    assert sorted(suffix_array(h, 4).tolist()) == list(range(len(h)))
    shard = Shard(h, words.first, 4)
    shard.search(Block(names, items, 4))
    for d, text in enumerate(docs):
        w, marks, found = text.split(), set(), set()
        for i, item in enumerate(items):
            q = item.split()
            n = min(4, len(q))
            windows = {tuple(q[j : j + n]) for j in range(len(q) - n + 1)} if q else set()
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in windows:
                    found.add(i)
                    marks |= set(range(j, j + n))
        assert set(np.flatnonzero(shard.hit[words.first[d] : words.first[d + 1]]).tolist()) == marks
        assert {int(i) for x, i, *_ in shard.found if x == d} == found


def base_spans(t):
    key = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out = [(m.start(), 0, m.end()) for m in key.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24])


@pytest.fixture(scope="module")
def scanner():
    return secrets.Scanner(secrets.BASE)


def test_secret_spans_equal_regexes(scanner):
    rng = random.Random(1)
    parts = ["token", "secret", "PassWord", "passwd", "api_key", "apikey", "=", ":", '"', "'", " ", "abc", "abcdef", "AKIA", "ABCDEFGHIJKLMNOPQ", "0123456789", "deadbeef", "é", "\n", "-", "x"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 50))) for _ in range(800)] + ["", None]
    for t in chunks(pa.array(texts)):
        where, got = code_points(t.data), collections.defaultdict(list)
        for a, r, b in scanner.scan(t.data):
            i = int(np.searchsorted(t.start, a, "right")) - 1
            got[i].append((int(where[a] - where[t.start[i]]), r, int(where[b] - where[t.start[i]])))
        for i in range(len(t.start)):
            assert sorted(got[i]) == base_spans(texts[t.lo + i] or "")


def test_automaton_is_minimal_and_runs_in_lanes():
    a = Automaton([("ab|cb", False)], search=False)
    assert a.states == 4  # start, after a or c, accepting, dead
    s = Automaton([("a{2,3}[0-9]+", False), ("x\\x41.", True)], search=True)
    data = np.frombuffer(b"aaa12 xAz aa7 \xff" * 700, np.uint8)
    assert (s.run(data, lanes=64) == s.run(data, lanes=1)).all()


PAYLOADS = [b"", b"a", bytes(range(256)) * 3, b"l" * 500 + b"k", bytes(640), "é".encode() * 999, b"\x00k\x00" * 300]


def test_jpeg_round_trip_and_determinism():
    rng = np.random.default_rng(0)
    raw = [*PAYLOADS, rng.integers(0, 256, 9000).astype(np.uint8).tobytes()]
    files = jpeg.encode([padded(r) for r in raw], [len(r) for r in raw])
    batch = jpeg.Batch(files)
    coef = batch.decode()
    tensors = jpeg.tensors(batch, coef)
    for r, f, image, t in zip(raw, files, batch.images, tensors, strict=True):
        assert jpeg.payload(image, coef) == (len(r), padded(r).tobytes())
        alone = jpeg.Batch([f])
        t2 = jpeg.tensors(alone, alone.decode())[0]
        assert t.shape == (image.height, image.width, 3) and (t == t2).all() and feature(t) == feature(t2)
    assert jpeg.encode([padded(raw[2])], [len(raw[2])])[0] == files[2]


def test_inverse_transform():
    coef = np.zeros((1, 64), np.int32)
    coef[0, 0], coef[0, 1] = 80, 40
    x = np.arange(8)
    want = np.rint(128 + 10 + 40 * 0.25 * np.sqrt(0.5) * np.cos((2 * x + 1) * np.pi / 16))
    assert (np.abs(jpeg.samples(coef)[0][3] - want) <= 1).all()


def test_zip_directories(tmp_path):
    plain = io.BytesIO()
    with zipfile.ZipFile(plain, "w") as z:
        z.writestr("a.txt", b"hello")
        z.writestr("dir/b.txt", b"x" * 999)
        z.comment = b"PK\x05\x06 inside"
    members = warc.directory(plain, len(plain.getvalue()))
    assert [(m.name, m.size) for m in members] == [("a.txt", 5), ("dir/b.txt", 999)]
    assert warc.read_at(plain, warc.member_start(plain, members[0]), 5) == b"hello"
    many = io.BytesIO()
    with zipfile.ZipFile(many, "w") as z:
        for i in range(65_600):  # more than 16 bits count
            z.writestr(zipfile.ZipInfo(str(i)), b"")
    assert len(warc.directory(many, len(many.getvalue()))) == 65_600
    path = f"file://{tmp_path}/x/one.wacz"
    w = warc.ArchiveWriter(path)
    w.add(1, "http://a b", b"payload\r\n\r\nWARC/1.1", None, "2024-01-01T00:00:00Z")
    w.add(2, None, b"", 1, "2024-01-01T00:00:00Z")
    w.close()
    (at, n), = warc.ranges(path)
    raw = (tmp_path / "x" / "one.wacz").read_bytes()[at : at + n]
    rows = [warc.parsed(h, b) for h, b in warc.records(raw)]
    assert [(r["page_id"], r["payload"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in rows] == [(1, b"payload\r\n\r\nWARC/1.1", "response", None, 19), (2, None, "revisit", 1, 0)]
    assert rows[0]["url"] == "http://a%20b"


LOREM = "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore."
PAGES = [
    (None, ""), ("", ""), ("just &amp; text\n two", "just & text two"), ("<html><body></body></html>", ""),
    (f"<nav><a href=x>m</a></nav><article><h1>T</h1><p><b>{LOREM}<br><p>b &copy;</article><footer>f</footer>", f"T\n{LOREM}\nb ©"),
    (f"<div class=sidebar><p>{LOREM}</div><div class=post><h1>T</h1><p>{LOREM}</p><div class=ad><p>{LOREM}</div></div><div id=comments><p>{LOREM} {LOREM}</div>", f"T\n{LOREM}"),
    (f"<main><h1>T</h1><section><p>{LOREM}</section><section class=comments><p>{LOREM}</section></main><form><p>{LOREM}</form>", f"T\n{LOREM}"),
    (f"<body><script>if(a<b){{}}</script><style>p{{}}</style><div id=cookie-notice>{LOREM}</div><div><p>{LOREM}", LOREM),
]


@pytest.mark.parametrize("page, text", PAGES)
def test_main_text(page, text):
    assert extract(page) == text


@given(st.text(alphabet="<>/!-&;=\"' apdivscrtbody\n", max_size=80))
@settings(max_examples=150, deadline=None)
def test_any_page_is_read(page):
    assert isinstance(extract(page), str)
