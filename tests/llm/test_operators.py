"""Training-data operators against brute force, round trips and held-out accuracy, with odd rows."""

import base64
import gzip
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from motifgrid.llm import bit_sliced, byte_bpe, language, minhash, packing, pii, quality, sharding, token_files, tokens, warc
from motifgrid.llm.common import new_path

DATA = "/root/testdata/sf0.001"
LIBRARY, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")
DOC = "doc_id long, text string, lang string, source string, n_chars long, ids string, part string, score string, __t string, label string"


@pytest.fixture(scope="module")
def rows():
    """(doc_id, text, lang, source): plain prose, copies, near copies, nulls, empty and very long texts, repeats."""
    r = random.Random(4)
    vocab = ["".join(r.choice("abcdeéß日") for _ in range(r.randint(1, 8))) for _ in range(300)]
    prose = lambda n: " ".join(r.choice(vocab) + r.choice(["", "", ".", ",", "\n"]) for _ in range(n))
    out = [(i, prose(r.randint(1, 120)), r.choice(["en", "de", None]), r.choice(["a", "b", None])) for i in range(60)]
    first = prose(200)
    out += [(100 + i, first, "en", "a") for i in range(12)]
    words = first.split()
    out += [(200 + i, " ".join(words[:i] + ["zz"] + words[i + 1 :]), "en", "a") for i in range(12)]
    out += [(300, None, "en", None), (301, "", None, "b"), (302, " \n\t ", "de", "b"), (None, "no id here", "en", "a"), (5, "twice", "en", "a"), (5, "twice", "en", "a"), (303, "x" * 5000, "en", "a"), (304, prose(20_000), "en", "a"), (305, "a  b\n\n c <|endoftext|> 🙂 ½", "en", "a")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*x, len(x[1] or ""), "i", "p", "s", "t", "l") for x in rows], DOC).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("false")


def library_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(LIBRARY)
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_units_equal_whole_texts():
    r = random.Random(1)
    held = tokens.library_encoder(LIBRARY)
    made = ["".join(r.choice("ab 'sé\n\t.,12 日\x85 ") for _ in range(r.randrange(60))) for _ in range(2000)]
    assert [np.frombuffer(x, "<u4").tolist() for x in held.encode(made)] == library_ids(made)


def test_token_files(spark, docs, rows, empty):
    path = new_path(spark, "tokens")
    token_files.write_tokens(docs, LIBRARY, path)
    got = token_files.file_digest(spark, path).orderBy("start").collect()
    ids = sorted(((x[0], x[1]) for x in rows), key=lambda x: (x[0] is not None, x[0] or 0))
    assert [r.doc_id for r in got] == [x[0] for x in ids]
    by = defaultdict(list)
    for (d, _), e in zip(ids, library_ids([t for _, t in ids]), strict=True):
        by[d].append((len(e) + 1, crc([*e, 0])))
    at = 0
    for r in got:
        assert r.start == at and (r.n_tokens, r.ids_crc32) in by[r.doc_id]
        at += r.n_tokens
    assert token_files.read_tokens(spark, path, first=100, last=103).count() == 4
    assert token_files.read_tokens(spark, path, ids=[303]).first().ids[-1] == 0
    path = new_path(spark, "tokens")
    token_files.write_tokens(empty, LIBRARY, path)
    assert token_files.file_digest(spark, path).count() == 0


def test_pii_base_and_added():
    r = random.Random(3)
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def brute(t):
        n = lambda s: len(pii.digits(s))
        ok = {"email": lambda s: True, "ip": lambda s: all(int(x) <= 255 for x in s.split(".")), "card": lambda s: 16 <= n(s) <= 19 and pii.luhn(pii.digits(s)), "phone": lambda s: 8 <= n(s) <= 15}
        return {k: [m.span() for m in re.finditer(p, t) if ok[k](m[0])] for k, p in plain.items()}

    parts = ["@", ".", "a", "-", "1", "22", "+", "(", ")", " ", "255", "300", "é", "%", "1.2.3.4", "+1 555 1234567", "4111111111111111"]
    for _ in range(5000):
        t = "".join(r.choice(parts) for _ in range(r.randrange(40)))
        assert pii.base(t) == brute(t)
    assert pii.base("9" * 200_000 + "a" * 200_000 + "@" * 1000)["email"] == []
    model = pii.trained()
    for t, kind in (("write to jane (at) example.com now", "email"), ("tel (030) 555-1234 today", "phone"), ("host 2001:db8:0:1:2:3:4:5 is up", "ip")):
        assert any(x[0] == kind for x in pii.found_spans(t, model)[1]), t
    assert pii.found_spans("version 1.20.300 of page 12345678 on 2024-01-02 at noon.today", model)[1] == []


def test_pii_dates_are_no_phones():
    model = pii.trained()
    for t in ("from 2019-01-01 to 2020-01-01 12", "on 03.04.2021 17 we met", "logged 2020/11/30 23 59 by hand", "between 1999-05-06 2001-07-08 it was kept", "call 14 12/10/2015 again"):
        assert pii.found_spans(t, model)[1] == [], t
    for t in ("tel (030) 555-1234 today", "call 212-555-0199 now", "phone 0049 301 2345678."):
        assert any(x[0] == "phone" for x in pii.found_spans(t, model)[1]), t


def test_pii_numbers_side_by_side_and_short_addresses():
    model = pii.trained()
    for t, kind, want in (
        ("tel 030 555 1234 2024-05-01", "phone", ["030 555 1234"]), ("tel 030 555 1234 030 555 1235", "phone", ["030 555 1234", "030 555 1235"]),
        ("host 2001:db8::1 up", "ip", ["2001:db8::1"]), ("server fe80::1 up", "ip", ["fe80::1"]), ("use a::b in page 10::20", "ip", []),
    ):
        assert [(k, t[a:b]) for k, a, b in sorted(pii.found_spans(t, model)[1], key=lambda x: x[1])] == [(kind, x) for x in want], t
    t = "1 " * 20_000
    assert len(pii.candidates(t, [])) <= 2 * pii.DIGITS * 20_000


def test_pii_frames(spark, docs, empty, rows):
    got = pii.spans(docs).collect()
    assert len(got) == len(rows) and all(r.spans == "" for r in got if r.n_email + r.n_ip + r.n_card + r.n_phone + r.n_added == 0)
    d = spark.createDataFrame([(1, "mail a.b@c.de or +1 555 123 4567."), (2, None)], "doc_id long, text string")
    assert [r.text for r in pii.redacted(d).orderBy("doc_id").collect()] == ["mail [EMAIL] or [PHONE].", None]
    one = pii.spans(d).filter("doc_id = 1").first()
    assert one.spans == "email:5:13,phone:17:32" and one.base_sha256 == hashlib.sha256(one.spans.encode()).hexdigest()
    assert pii.spans(empty).count() == 0 and pii.redacted(empty).columns == docs.columns


def test_boilerplate_is_a_line_of_stock_phrases(spark):
    prose = [
        "The catalog in this hall holds many old maps and charts.",
        "A word about the spread more than twenty other words follow here, and none of them is on its own.",
        "Please subscribe to the idea that every old map in this hall was drawn by people who had walked the whole way, and read more than we do.",
        "They sign up for the long walk, log in hand, and learn more about us than we ever told the others who came.",
    ]
    stock = ["Read more", "Sign up | Log in", "All rights reserved.", "This work is licensed under the GNU General Public License, version 3.", "Privacy Policy - Terms of Use - Contact us!", "© 2020 All rights reserved."]
    rest = "Every other line of this text is plain prose that nobody would want to lose, and it goes on for a while before it ends."
    for lines, bad in ((prose, False), (stock, True)):
        d = spark.createDataFrame([(i, f"{rest}\n{x}\n{rest[::-1].capitalize()}.") for i, x in enumerate(lines)], "doc_id long, text string")
        got = {r.doc_id: r.lost_chars for r in quality.measured(d).collect()}
        assert got == {i: len(re.sub(r"[\x20\x09-\x0D]", "", x)) if bad else 0 for i, x in enumerate(lines)}


def test_clean_documents_are_left_alone(spark):
    d = "/root/testdata/sf0.01"
    clean = spark.read.parquet(f"{d}/labels.parquet").filter("quality = 1").select("doc_id").distinct()
    got = quality.measured(spark.read.parquet(f"{d}/documents.parquet")).join(clean, "doc_id").filter("not base_failed").select("kept").collect()
    assert len(got) > 200 and sum(r.kept for r in got) >= 0.99 * len(got)


def test_quality(spark, docs, rows, empty):
    extra = [(900, "a b c d e f g h i j " * 4, None, None), (901, "word | nav | link | home | x | y\n" * 3 + " ".join(f"w{i}" for i in range(30)) + ".", None, None), (902, ("Plain words stand in this line and they end well enough here now. " * 1).strip() + "\nclick here\nA second line with ten other words closes the whole text here too.", None, None)]
    d = docs.unionByName(spark.createDataFrame([(*x, 0, "i", "p", "s", "t", "l") for x in extra], DOC))
    texts = defaultdict(list)
    for x in [*rows, *extra]:
        texts[x[0]].append(x[1] or "")
    def expected(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        runs = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        n = Counter(runs)
        held = {j for i, x in enumerate(runs) if n[x] > 1 for j in range(i, i + 8)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(held), len(w) < 20 or 100 * len(held) > 30 * len(w))

    got = quality.measured(d).collect()
    assert len(got) == sum(map(len, texts.values()))
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) in map(expected, texts[r.doc_id])
        assert not (r.base_failed and r.kept)
    kept = {r.doc_id: r for r in quality.cleaned(d).collect()}
    assert 901 not in kept and "click" not in kept[902].text and kept[902]["__t"] == "t"
    assert quality.cleaned(empty).columns == docs.columns and quality.measured(empty).count() == 0


def test_packing(spark, docs, rows, empty):
    got = packing.packed(docs, LIBRARY, window=256, shard_docs=16, with_ids=True).collect()
    whole = defaultdict(list)
    for x, e in zip(rows, library_ids([x[1] for x in rows]), strict=True):
        whole[x[0]].append([*e, 1])
    assert sum(r.length for r in got) == sum(len(e) for v in whole.values() for e in v)
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
        assert any(r.ids_crc32 == crc(e[r.start : r.start + r.length]) and r.doc_tokens == len(e) for e in whole[r.doc_id])
        assert np.frombuffer(r.ids, "<u4").tolist() in [e[r.start : r.start + r.length] for e in whole[r.doc_id]]
    for d, v in by.items():
        if len(whole[d]) == 1:
            v.sort(key=lambda r: r.start)
            assert [r.start for r in v] == np.cumsum([0, *(r.length for r in v)])[:-1].tolist()
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append(r)
    for v in sequences.values():
        v.sort(key=lambda r: r.offset)
        n = sum(r.length for r in v)
        assert [r.offset for r in v] == np.cumsum([0, *(r.length for r in v)])[:-1].tolist() and n <= 256 and n & (n - 1) == 0
    assert packing.packed(empty, LIBRARY).count() == 0


def test_units_are_encoded_once():
    """Words are encoded apart from the marks, digits and line feeds beside them, and once, however many forms they come in."""
    held, taken = tokens.library_encoder(LIBRARY), []
    counted = tokens.UnitEncoder(held.backend, single=lambda units: taken.extend(units) or held.single(units))
    words = [a + b + c for a in "abc" for b in "uvé" for c in ("th", "er", "on")]
    made = ["\n".join(f"{w}{m} {w}{m}{i}" for w in words) for i, m in enumerate([".", ",", "!!", "***", ",%%%", "@", ":", "?"])]
    assert [np.frombuffer(x, "<u4").tolist() for x in counted.encode(made)] == library_ids(made)
    assert len(taken) == len(set(taken)) <= 2 * len(words) + 8 + 8 + 1


def test_units_of_odd_columns():
    """Cuts by classes of bytes change no id: signs, white space of all kinds, contractions, other scripts, slices, nulls."""
    import pyarrow as pa

    r = random.Random(9)
    atoms = ["a", "b", "Ab", "\u00e9", "\u00d7", "\u00f7", "\u024f", "\u0250", "\u03a9", "\u65e5", "\u00bd", "\u0663", "'", "'s", "'ll", "'t", "\u2019", "\u201c", "\u2026", "  ", "\n", "\n\n", "\t", "\r\n", "\x1c", "\x00", "\x7f"]
    atoms += ["\x85", "\xa0", "\u1680", "\u180e", "\u2003", "\u200b", "\u2028", "\u202f", "\u205f", "\u3000", ".", ",", "***", "1", "23", "\U0001f642", "e\u0301", "_", "@", "<|endoftext|>"] + [" "] * 6
    made = ["".join(r.choice(atoms) for _ in range(r.randint(0, 12))) for _ in range(4000)] + [None, ""]
    held = tokens.library_encoder(LIBRARY)
    for kind, first in ((pa.string(), 0), (pa.large_string(), 5)):
        ids, at = held.encoded(pa.array(made, kind)[first:])
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == library_ids(made[first:])
    assert [len(x) for x in held.encoded(pa.array([], pa.string()))] == [0, 1]


def test_documents_in_columns():
    """Counts by token id and the written form, with ids of both widths."""
    import pyarrow as pa

    r = np.random.default_rng(2)
    docs = [r.integers(0, top, n).astype("<u4") for top, n in ((50, 80), (70_000, 40), (5, 1), (300, 300))]
    for some in (docs, docs[2:], docs[1:2]):
        at = np.cumsum([0, *map(len, some)])
        counts, want = packing.documents_with(np.concatenate(some), at), Counter(int(k) for x in some for k in set(x.tolist()))
        assert {int(k): int(counts[k]) for k in np.flatnonzero(counts)} == want
        width = np.array([2 if x.max() < 65536 else 4 for x in some], np.int32)
        column = packing._column(np.concatenate(some), at, width)
        assert column.to_pylist() == [x.astype(f"<u{w}").tobytes() for x, w in zip(some, width, strict=True)]
        ids, back = packing._ids(pa.RecordBatch.from_arrays([column, pa.array(width)], names=["ids", "width"]))
        assert ids.tolist() == np.concatenate(some).tolist() and back.tolist() == at.tolist()


def test_retrieval_prefers_shared_words():
    idf = np.ones(100)
    index = packing.Bm25([np.array([1, 2, 3]), np.array([50, 51]), np.array([2, 3, 60])], idf, 3)
    assert index.rank(0, np.array([False, True, True])).tolist() == [2, 1]


@pytest.mark.parametrize("n", [0, 3, 700])
def test_bit_sliced(spark, n):
    r = np.random.default_rng(n)
    made = [(int(i), [float(x) for x in v]) for i, v in enumerate(np.round(r.normal(size=(n, 9)), 2))]
    made += [(10_000 + i, [0.5] * 9) for i in range(60 if n else 0)]  # ties
    odd = [(20_000, None), (20_050, [1.0, None]), (20_100, [float("nan")]), (20_150, [float("inf")]), (None, [1.0]), (20_200, []), (20_250, [1.0, -2.0])]
    d = spark.createDataFrame(made + (odd if n else []), "vec_id long, embedding array<double>")
    q = bit_sliced.quantised(d)
    got = defaultdict(list)
    for x in bit_sliced.top_k(q, q.filter("vec_id % 50 = 0"), 5, 128, 8).collect():
        got[x.query_id].append((x.rank, x.vec_id, x.score))
    whole = {i: np.pad(np.floor(256 * np.array(v)), (0, 9 - len(v))).astype(int) for i, v in made + ([(20_250, [1.0, -2.0]), (20_200, [])] if n else [])}
    for i, v in whole.items():
        if i % 50 == 0:
            best = sorted((-int(v @ o), j) for j, o in whole.items() if j != i)[:5]
            assert sorted(got.pop(i, [])) == [(k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert not got


def test_bit_sliced_empty_vectors(spark):
    """An empty vector has a sum of 0 with all others."""
    for made, want in (([(50, [1.0]), (1, []), (2, [-1.0])], [(50, 1, 1, 0), (50, 2, 2, -(256**2))]), ([(50, []), (100, [])], [(50, 1, 100, 0), (100, 1, 50, 0)])):
        q = bit_sliced.quantised(spark.createDataFrame(made, "vec_id long, embedding array<double>"))
        assert sorted(tuple(r) for r in bit_sliced.top_k(q, q.filter("vec_id % 50 = 0")).collect()) == want


def test_bit_sliced_large_values_and_repeated_ids(spark):
    """Components of any size are ranked by their exact sums; rows that repeat an id ask, and answer, each."""
    made = [(50, [1.0, 0.0]), (50, [0.0, 1.0]), (1, [100_000.0, 0.0]), (2, [90_000.0, 0.0]), (3, [3e9, -3e9]), (4, [1e30, 0.0]), (5, [-2.0, 7.0])]
    d = spark.createDataFrame([(*x, 1, "r") for x in made], "vec_id long, embedding array<double>, v int, row string")
    q = bit_sliced.quantised(d)
    held = [(i, [max(-(2**63), min(2**63 - 1, int(np.floor(256 * c)))) for c in v]) for i, v in made]
    want = Counter()
    for a, (i, v) in enumerate(held):
        if i % 50 == 0:
            scores = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), j) for b, (j, w) in enumerate(held) if a != b)[:5]
            want.update((i, n + 1, j, min(-s, 2**63 - 1)) for n, (s, j) in enumerate(scores))
    assert Counter(tuple(r) for r in bit_sliced.top_k(q, q.filter("vec_id % 50 = 0"), 5, 4, 2).collect()) == want


def test_bit_sliced_queries_are_not_broadcast(spark):
    """However small the files of the queries are: copies of them, one a shard, outgrow any driver."""
    made = [(i, [float(i % 7), float(i % 5)]) for i in range(400)]
    q = bit_sliced.quantised(spark.createDataFrame(made, "vec_id long, embedding array<double>"))
    plan = bit_sliced.top_k(q, q.filter("vec_id % 50 = 0"), 5, 16)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Broadcast" not in plan and "Generate" not in plan


def test_warc_of_no_pages(spark):
    d = spark.createDataFrame([], "page_id long, url string, html string")
    source, target, index = (new_path(spark, x) for x in ("s", "t", "i"))
    warc.write_archives(d, source)
    warc.normalise(spark, source, target, index)
    assert warc.read_records(spark, target, index).count() == 0


def test_warc(spark):
    made = [(i, f"http://x/{i}", f"<p>é{i % 7}</p>" if i % 3 else None) for i in range(40)] + [(None, None, "<p>é1</p>"), (4, "u\nv", "<p>é4</p>"), (99, "big", "z" * 300_000)]
    d = spark.createDataFrame([(*x, "e") for x in made], "page_id long, url string, html string, first string")
    source, target, index = (new_path(spark, x) for x in ("s", "t", "i"))
    warc.write_archives(d, source)
    warc.normalise(spark, source, target, index)
    first = {}
    for i, _, h in made:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = Counter()
    for i, _, h in made:
        p = (h or "").encode()
        to = first[h or ""]
        want[i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if to == i else "revisit", None if to == i else to] += 1
    assert Counter(tuple(r) for r in warc.read_records(spark, target, index).collect()) == want
    for folder, members in ((source, False), (target, True)):
        path = "/" + folder.split(":", 1)[1].lstrip("/")
        files = [f.path for f in pafs.LocalFileSystem().get_file_info(pafs.FileSelector(path, recursive=True)) if "/part-" in f.path]
        with open(files[0], "rb") as f:
            data = f.read()
        whole = gzip.decompress(data)
        assert whole.startswith(b"WARC/1.1") and (data.count(b"\x1f\x8b\x08") > 1) == members and files[0].endswith(".gz") != members


def test_warc_streams():
    made = [warc.record(i, None, b"x\n\r\n" * i, None) for i in range(50)]
    whole = b"".join(made)
    for step in (1, 7, 1000):
        assert list(warc.records(whole[i : i + step] for i in range(0, len(whole), step))) == made
    for bad in (whole[:-100], whole + b"other\r\n\r\n", whole[50:]):
        with pytest.raises(ValueError):
            list(warc.records([bad]))


def test_warc_archive_of_another_writer(spark, tmp_path):
    """One gzip stream of many records, and one of several members, in volumes of a few records; bytes of all kinds in the payloads."""
    r = random.Random(3)
    made = [(i, r.choice(["\n", "\r\n\r\n", "\n\n\n", "é" * 50]) * r.randrange(60) + f"<p>{i}</p>") for i in range(200)] + [(500, "y\n" * 200_000), (501, "")]
    data = [warc.record(i, f"http://x/{i}", h.encode(), None) for i, h in made]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.warc.gz").write_bytes(gzip.compress(b"".join(data[:150])))
    (tmp_path / "in" / "two.warc.gz").write_bytes(b"".join(map(gzip.compress, data[150:])))
    target, index = (new_path(spark, x) for x in ("t", "i"))
    warc.normalise(spark, f"file://{tmp_path}/in", target, index, volume_bytes=20_000)
    got = warc.read_records(spark, target, index).collect()
    assert sorted((x.page_id, x.payload_bytes, x.payload_digest) for x in got) == sorted((i, len(h.encode()), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()) for i, h in made)
    offsets = [x.offsets for x in spark.read.parquet(index).collect()]
    assert len(offsets) > 3 and sum(len(x) - 1 for x in offsets) == len(made)
    (tmp_path / "in" / "three.warc.gz").write_bytes(gzip.compress(data[0][:-30]))
    with pytest.raises(Exception, match="inside a record"):
        warc.normalise(spark, f"file://{tmp_path}/in/three.warc.gz", new_path(spark, "t"), new_path(spark, "i"))


def components(sets, links=None):
    """Smallest member of each component, by given links or by those of the sets."""
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links or ():
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    for a in sets if links is None else ():
        for b in sets:
            if a < b and sets[a] and sets[b]:
                n = len(sets[a] & sets[b])
                if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {d: find(d) for d in sets}


def test_near_duplicates(docs, rows, empty):
    sets = {}
    for d, t, *_ in rows:
        w = (t or "").encode().lower().split()
        if d is not None:
            sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    want = components({d: s for d, s in sets.items() if d != 5})  # 5 stands for two texts
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id not in (None, 5):
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id), r
    assert minhash.near_duplicates(empty).count() == 0


def test_components_of_a_chain(spark):
    n = list(range(60))
    random.Random(2).shuffle(n)
    links = spark.createDataFrame(list(zip(n[:-1], n[1:], strict=True)) + [(100, 101)], "a long, b long")
    assert {(r.node, r.label) for r in minhash.components(links).collect()} == {(x, 0) for x in n} | {(100, 100), (101, 100)}


def test_language(spark, docs, empty, rows):
    d = spark.read.parquet(f"{DATA}/documents.parquet")
    got = language.language_of(d).join(d.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null").collect()
    assert len(got) > 30 and sum(r.lang == r.lang_pred for r in got) / len(got) > 0.95
    by = defaultdict(list)
    for r in language.language_of(docs).collect():
        by[r.doc_id].append(r)
        assert r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
    assert sum(map(len, by.values())) == len(rows) and {by[i][0].lang_pred for i in (300, 301, 302)} == {"und"}
    assert {r.lang_pred for r in language.language_of(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language.language_of(empty).count() == 0


def test_sharding(docs, rows, empty):
    got = sharding.sharded(docs, 7).collect()
    assert len(got) == len(rows)
    shards = defaultdict(list)
    for r in got:
        shards[r.shard].append(r.slot)
    assert set(shards) == set(range(7)) and max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in shards.values())
    sizes = {(r.doc_id, r.size, r.text_crc32) for r in got}
    assert {(d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, *_ in rows} == sizes
    source = {d: s for d, _, _, s in rows}
    for s in ("a", "b", None):
        n = [sum(source[r.doc_id] == s for r in got if r.shard == i) for i in range(7)]
        assert max(n) - min(n) <= 2
    assert sharding.sharded(empty, 7).count() == 0


def test_byte_bpe(docs, rows, empty):
    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    held = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for d, t, *_ in rows:
        ids = held.encode_ordinary(t or "")
        want[d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in byte_bpe.digests(docs, RANKS, P.PATTERN, True).collect()) == want
    assert Counter(tuple(r) for r in byte_bpe.digests(docs, RANKS, P.PATTERN).collect()) == want
    assert byte_bpe.digests(empty, RANKS, P.PATTERN).count() == 0
    r, (bpe, _) = random.Random(9), byte_bpe.codec(RANKS, P.PATTERN)
    for _ in range(3000):
        s = bytes(r.choice(b"aeinorst thouing\xc3\xa9") for _ in range(r.randrange(1, 40)))
        assert list(bpe.encode_match(s)) == held._encode_single_piece(s) if s not in ranks else True


def test_byte_bpe_on_every_code_point():
    """Letters and numbers are those of the library, whatever the version of the installed tables."""
    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    held = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    _, encoder = byte_bpe.codec(RANKS, P.PATTERN, True)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 2000):
        text = " ".join(f"{c}'s{c}1{c}" for c in points[at : at + 2000])
        assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == held.encode_ordinary(text), hex(at)


def test_pii_spelled_names_of_any_length():
    for name in ("a" * 100, " dot ".join("abcdefgh"), "x (dot) y [dot] z"):
        text = f"write: {name} (at) example.com, {name} (at) example.com"
        assert [text[a:b] for k, a, b in pii.candidates(text, []) if k == "email"] == [f"{name} (at) example.com"] * 2


def plain_bayes(train, texts):
    """Multinomial naive Bayes over hashed n-grams, one text at a time."""
    def grams(t):
        t = re.sub(r"\s+", " ", "".join(c if c.isalpha() else " " for c in (t or "").lower()))
        t = t[1:] if t[:1] == " " else t
        out = []
        for n in language.ORDERS:
            for i in range(len(t) - n + 1):
                h = 0
                for c in t[i : i + n]:
                    h = ((h ^ ord(c)) * 0x01000193) % 2**32
                h = (h + n) % 2**32
                out.append((((h ^ (h >> 15)) * 0x2C1B3C6D) % 2**32) >> 18)
        return out

    counts, docs = defaultdict(Counter), Counter()
    for lang, t in train:
        docs[lang] += 1
        counts[lang].update(grams(t))
    whole = {k: sum(v.values()) + 0.5 * language.BUCKETS for k, v in counts.items()}
    out = []
    for t in texts:
        g = grams(t)
        logs = {k: np.log(docs[k] / sum(docs.values())) + sum(np.log((counts[k][b] + 0.5) / whole[k]) for b in g) for k in sorted(docs)}
        best = max(logs, key=logs.get) if g else "und"
        out.append((best, 1 / sum(np.exp(v - logs[best]) for v in logs.values()) if g else 0.0))
    return out


def test_language_equals_plain_bayes(docs, rows):
    train = [(x[2], x[1]) for x in rows if x[2] is not None and x[1] is not None and zlib.crc32(str("" if x[0] is None else x[0]).encode()) % 3 != 1]
    few = [x for x in rows if x[0] != 304]
    want = defaultdict(list)
    for x, (lang, score) in zip(few, plain_bayes(train, [x[1] for x in few]), strict=True):
        want[x[0]].append((lang, score))
    for r in language.language_of(docs).filter("doc_id is null or doc_id <> 304").collect():
        assert any(r.lang_pred == lang and abs(r.score - score) < 1e-3 for lang, score in want[r.doc_id]), r


def family(members, template, own, shared):
    """Texts alike at 0.70 by a template; the last two also share the first words of their ends."""
    head = " ".join(f"t1x{j}" for j in range(template))
    texts = [f"{head} " + " ".join(f"w{i}x{j}" for j in range(own)) for i in range(members)]
    pair = " ".join(f"both{j}" for j in range(shared))
    return texts[:-2] + [f"{head} {pair} " + " ".join(f"w{i}x{j}" for j in range(own - shared)) for i in (members - 2, members - 1)]


def test_near_duplicates_in_a_family(spark):
    texts = family(1000, 144, 30, 9)
    sets = [minhash_words(x) for x in texts]
    alike = lambda a, b: len(a & b) / len(a | b)
    assert alike(sets[-1], sets[-2]) >= 0.75 > 0.71 > alike(sets[0], sets[1]) > 0.69
    found = minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in found} == {i: min(i, 998) for i in range(1000)}


def minhash_words(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def test_parities_lose_no_pair():
    """Every pair that is alike enough is possible, and exact forests join just the linked texts."""
    r = np.random.default_rng(3)
    base = np.sort(r.integers(0, 2**63, 900, dtype=np.uint64))
    made = [np.unique(np.concatenate([base[: r.integers(20, 900)], r.integers(0, 2**63, r.integers(0, 120), dtype=np.uint64)])) for _ in range(150)]
    n, doc = np.array([len(x) for x in made]), np.arange(len(made))
    m = minhash.Members(doc, n, doc, [minhash.parity(x) for x in made], [x.tobytes() for x in made])
    found = {tuple(sorted((int(m.doc[i]), int(m.doc[j])))) for i, js, _ in minhash.possible(m, m, True) for j in js}
    both = lambda a, b: len(np.intersect1d(made[a], made[b]))
    linked = {(a, b) for a in range(150) for b in range(a + 1, 150) if 100 * both(a, b) >= 75 * (n[a] + n[b] - both(a, b))}
    assert linked <= found and {(a, b) for a in range(150) for b in range(a + 1, 150) if minhash.alike(made[a], made[b])} == linked
    roots = lambda edges: components({d: {d} for d in range(150)}, edges)
    assert roots(minhash.forest(m, m, True)) == roots(linked)
    odd, even = (minhash.Members(doc[i::2], n[i::2], doc[i::2], [minhash.parity(x) for x in made[i::2]], [x.tobytes() for x in made[i::2]]) for i in (1, 0))
    across = {x for x in linked if (x[0] + x[1]) % 2}
    assert roots(minhash.forest(odd, even, False)) == roots(across)


def test_near_duplicates_with_repeated_ids(spark):
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words), " ".join(words[:-1]), " ".join(f"u{i}" for i in range(60))]
    d = spark.createDataFrame([(1, texts[0]), (1, texts[0]), (9, texts[0]), (9, texts[2]), (7, texts[1]), (None, texts[2]), (None, "alone here"), (8, None)], "doc_id long, text string")
    got = Counter((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(d).collect())
    assert got == Counter([(1, 1, True), (1, 1, True), (9, 1, False), (9, 9, True), (7, 1, False), (None, 9, False), (None, None, True), (8, 8, True)])
