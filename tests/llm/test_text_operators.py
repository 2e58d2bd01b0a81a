"""Quality rules, media columns, WARC bundles and byte-level BPE: exact values, round trips and odd inputs."""

import base64
import hashlib
import os
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from skyloom.llm import bpe, media, oracles, quality_rules, registry, warc

LONG = "Some words here. " * 8000
ODD = [None, "", " \n\t ", "one", "Tie tie.\nTie tie.", "Zürich déjà vu – 日本 😀 ok\x1c\x85.", "a  b\n c\r\n\td", "x" * 3000, LONG, "Some words here. Some words here."]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, each twice, with further columns whose names clash with the operators' own."""
    rows = [(i, t, "n", 1) for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows + rows, "doc_id long, text string, words string, kept int")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, words string, kept int")


def brute_rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    covered = set()
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            covered |= set(range(i, i + 5))
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_rules_match_brute_force(spark, odd, sf):
    short = odd.where(F.length("text") < 5000).union(spark.read.parquet(f"{sf}/documents.parquet").where(F.length("text") < 3000).select("doc_id", "text", "lang", F.lit(0)))
    rows = quality_rules.clean_documents(short, keep=("doc_id", "text")).collect()
    assert len(rows) > 100
    for r in rows:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_rules(r["text"])
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])


def test_rules_on_odd_rows(spark, odd):
    assert quality_rules.clean_documents(odd).count() == 2 * len(ODD)
    assert quality_rules.clean_documents(empty(spark)).count() == 0


@pytest.mark.parametrize(
    "line, verdict",
    [
        ("A plain sentence of some length, as books have it.", ""),
        ("Home | News | Sports | Weather | Contact", "navigation"),
        ("Word*** more$$$ and### so&&& on%%%", "punctuation"),
        ("BUY!! NOW!! CHEAP!! WATCHES!! HERE!!", "punctuation"),
        ("THIS WHOLE LINE IS IN CAPITAL LETTERS", "navigation"),
        ("This site uses cookies to work better.", "boilerplate"),
        ("and and and and so so so so it it it", "boilerplate"),
        ("C# and R&D cost $5 in 2020.", ""),
    ],
)
def test_line_verdicts(line, verdict):
    assert quality_rules.line_verdict(line, line.split(), quality_rules.Rules()) == verdict


def test_cleaning_cuts_lines_and_rejects_documents():
    good = "A plain sentence of some length, as books have it, goes on here."
    mixed = quality_rules.assess("\n".join([good] * 1 + ["Another plain sentence follows the first one, also of some length."] * 1 + ["Home | News | Sports | Contact"]), quality_rules.Rules())
    assert mixed["kept"] and "Home" not in mixed["clean_text"]
    assert not quality_rules.assess(good + "\n" + "Home | News | Sports | Contact | " * 9, quality_rules.Rules())["kept"]


def test_rules_equal_their_oracle(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    df = registry.op2_quality_rules(spark, sf)
    want = con.sql(oracles.quality_rules_sql())
    assert sorted(tuple(r[c] for c in want.columns) for r in df.collect()) == sorted(want.fetchall())


def test_media_round_trip(spark, odd):
    rows = media.encode_media(odd).collect()
    assert len(rows) == 2 * len(ODD)
    by_id = {}
    for r in rows:
        raw = (ODD[r["doc_id"]] or "").encode()
        payload = media.from_wav(bytes(r["media"]))
        assert payload.startswith(raw) and set(payload[len(raw) :]) <= {32} and len(payload) % 192 == 0 and payload
        assert r["n_bytes"] == len(raw) and r["payload_bytes"] == len(payload) and r["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(payload[-16:]) and r["media_sha256"] == hashlib.sha256(bytes(r["media"])).hexdigest()
        assert len(r["times"]) == len(r["codes"]) and r["times"] == sorted(r["times"])
        by_id.setdefault(r["doc_id"], set()).add(r["feature"])
    assert all(len(x) == 1 for x in by_id.values()) and by_id[0] == by_id[1]
    assert media.encode_media(empty(spark)).count() == 0


def test_fingerprint_finds_a_tone():
    t = np.arange(19200) / 8000
    samples = (128 + 100 * np.sin(2 * np.pi * 1000 * t)).astype(np.uint8).tobytes()
    _, codes = media.fingerprints(samples)
    assert np.bincount(codes >> 16).argmax() == round(1000 * 192 / 8000)


def plain_fingerprints(samples, frame=192, hop=96, peaks=3, ahead=4):
    """Frame by frame: magnitudes, local maxima, the highest of them, pairs with the next frames."""
    x = np.frombuffer(samples, np.uint8).astype(np.float32) - 128
    window = np.hanning(frame).astype(np.float32)
    tops = []
    for at in range(0, max(len(x), frame) - frame + 1, hop):
        cut = np.pad(x[at : at + frame], (0, max(0, frame - len(x))))
        mag = [int(v) for v in np.rint(np.abs(np.fft.rfft(cut * window)) * 16)]
        local = [k for k in range(1, len(mag) - 1) if mag[k] > mag[k - 1] and mag[k] >= mag[k + 1]]
        tops.append(sorted(local, key=lambda k: (-mag[k], k))[:peaks])
    return sorted((i, (a << 16) | (b << 8) | dt) for i, own in enumerate(tops) for dt in range(1, ahead + 1) if i + dt < len(tops) for a in own for b in tops[i + dt])


def test_fingerprints_equal_plain_loops():
    r = np.random.default_rng(5)
    samples = [media.payload_of(t)[1] for t in ("", "a", "word " * 500, "é" * 1000, "tick tock\n" * 300)] + [bytes(r.integers(0, 256, 192 * n, dtype=np.uint8)) for n in (1, 2, 3, 17, 60)]
    for payload in samples:
        times, codes = media.fingerprints(payload)
        assert list(zip(times.tolist(), codes.tolist())) == plain_fingerprints(payload)
        short = media.fingerprints(payload, media.Spectrum(batch=2))
        assert (short[0] == times).all() and (short[1] == codes).all()
    # The transform itself, by its sum.
    x = r.normal(size=192)
    n = np.arange(192)
    plain = [abs(sum(x * np.exp(-2j * np.pi * k * n / 192))) for k in range(97)]
    assert np.allclose(np.abs(np.fft.rfft(x)), plain)


@pytest.fixture(scope="module")
def pages(spark):
    same = "<p>same é</p>"
    rows = [(5, "http://a/5", same), (3, "http://a/3", same), (9, None, same), (1, "u", None), (2, "u\r\nX: y", ""), (4, "u", "big " * 200_000), (7, "u", "own"), (7, "u", "own"), (None, "u", same), (None, "u", "alone")]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload_digest", F.lit("clash"))


def test_warc_round_trip(pages):
    layout = warc.Layout(frame_bytes=300, bundle_bytes=200)
    bundles = warc.write_bundles(pages, layout)
    rows = warc.read_bundles(bundles, payloads=True).collect()
    assert len(rows) == pages.count()
    kinds = {(r["page_id"], r["record_type"], r["refers_to"]) for r in rows}
    assert {(5, "revisit", 3), (3, "response", None), (9, "revisit", 3), (1, "response", None), (2, "revisit", 1), (4, "response", None), (7, "response", None), (None, "revisit", 3), (None, "response", None)} == kinds
    html = {r["page_id"]: (r["html"] or "").encode() for r in pages.where("page_id IS NOT NULL").collect()}
    for r in rows:
        if r["page_id"] is not None:
            assert r["payload_bytes"] == len(html[r["page_id"]]) and r["payload_digest"] == base64.b32encode(hashlib.sha1(html[r["page_id"]]).digest()).decode()
            assert r["payload"] is None if r["record_type"] == "revisit" else bytes(r["payload"]) == html[r["page_id"]]
    # Every record can be read alone by its place in the index.
    for b in bundles.collect():
        archive = bytes(b["archive"])
        for x in b["index"]:
            row, end = warc.parse(warc.read_record(archive, x["frame"], x["offset"], x["length"]))
            assert end == x["length"] and ("" if row["page_id"] is None else str(row["page_id"])) == x["record_id"]


def test_warc_frames_are_plain_zstandard(pages):
    import io

    import zstandard

    for b in warc.write_bundles(pages).collect():
        whole = b"".join(iter(lambda s=zstandard.ZstdDecompressor().stream_reader(io.BytesIO(bytes(b["archive"])), read_across_frames=True): s.read(65536), b""))
        assert whole.count(b"WARC/1.1\r\n") == b["n_records"]


def test_warc_damage_is_found():
    data = warc.record(1, "u", b"payload", warc.digest(b"other"), None)
    with pytest.raises(ValueError):
        warc.parse(data)


def test_warc_empty(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_bundles(warc.write_bundles(none)).count() == 0


@pytest.fixture(scope="module")
def encoding():
    path = P.path("byte_bpe_50k.tiktoken")
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=dict(bpe.read_ranks(path)), special_tokens={})


def test_bpe_equals_tiktoken(spark, odd, encoding):
    rows = bpe.encode_documents(odd, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, outputs=("n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256"), block_chars=500).collect()
    assert len(rows) == odd.count()
    for r in rows:
        text = ODD[r["doc_id"]] or ""
        ids = encoding.encode_ordinary(text)
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and bytes(r["decoded"]) == text.encode()
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode_documents(empty(spark), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_bpe_of_very_long_words(spark, encoding):
    rng = random.Random(5)
    texts = ["x" * 1_000_000, "".join(rng.choice("abcdefgé") for _ in range(30_000)), " ".join("".join(rng.choice("etaoin") for _ in range(n)) for n in range(250, 262)), None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = bpe.encode_documents(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, outputs=("ids",)).collect()
    ranks = dict(bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")))
    assert {r["doc_id"]: r["ids"] for r in rows if r["doc_id"]} == {i: encoding.encode_ordinary(t or "") for i, t in enumerate(texts) if i}
    assert next(r["ids"] for r in rows if r["doc_id"] == 0) == bpe.merge_long(b"x" * 1_000_000, ranks)
    for n in range(1, 300):
        word = "".join(rng.choice("thean") for _ in range(n)).encode()
        assert bpe.merge_long(word, ranks) == encoding._encode_single_piece(word)


def test_bpe_on_documents(spark, sf, encoding):
    docs = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    for r in registry.op10_byte_bpe(spark, sf).collect():
        ids = encoding.encode_ordinary(docs[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())


def test_tokenizer_files_stay_outside():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    assert not [f for d, _, fs in os.walk(root) if ".git" not in d for f in fs if f.endswith((".tiktoken", ".model"))]
