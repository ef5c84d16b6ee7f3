import hashlib
import os
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from siftwright.llm import bpe, pii, transport

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)


def same_as_library(texts):
    p = bpe.pieces(PATH)
    ids, bounds = bpe.encode(p, texts)
    data, offsets = bpe.decode(p, ids, bounds)
    for k, wanted in enumerate(LIBRARY.encode(texts, add_bos=True, add_eos=True)):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == wanted
        assert data[offsets[k] : offsets[k + 1]].tobytes().decode() == LIBRARY.decode(wanted)


def test_encoding_equals_library():
    random.seed(4)
    signs = "ab  the\n\t▁é😀漢\x00.,12ZQxing  "
    made = ["".join(random.choice(signs) for _ in range(random.randint(0, 50))) for _ in range(800)]
    same_as_library(["", " ", "▁", "a" * 3000, "ab" * 500 + "the" * 300, " " * 700, "<s> x </s>", "<0x41>", *made])


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=60), min_size=1, max_size=5))
def test_encoding_of_any_text(texts):
    same_as_library(texts)


def test_encode_odd_rows(odd, empty):
    rows = bpe.encode_documents(odd, PATH, keep=("doc_id", "row")).collect()
    assert len(rows) == odd.count() and all(r.ids[0] == 1 and r.ids[-1] == 2 for r in rows)
    texts = sorted((r.doc_id or -1, r.text or "") for r in odd.collect())
    assert sorted((r.doc_id or -1, r.decoded) for r in rows) == texts
    assert bpe.digest_documents(empty, PATH).count() == 0 and bpe.digest_documents(odd, PATH).count() == odd.count()


def test_transport_round_trips():
    for n in [*range(0, 400, 7), 16369, 16370, 16384, 16385, 70001]:
        payload = os.urandom(n)
        found = transport.demux(transport.mux(payload))
        assert b"".join(u.data for u in found.units) == payload
        assert (found.lost, found.continuity_errors, found.table_errors, found.programs, found.streams) == (0, 0, 0, {1: 0x1000}, {0x100: 6})
        assert [u.stamp for u in found.units] == [9000 + 3600 * k for k in range(len(found.units))] and all(u.random_access for u in found.units)


def test_transport_damage():
    media = transport.mux(bytes(range(256)) * 200)
    packets = [media[k : k + 188] for k in range(0, len(media), 188)]
    gone = transport.demux(b"".join(packets[:5] + packets[6:]))
    assert gone.continuity_errors == 1 and not gone.units[0].complete and gone.units[1].complete
    again = transport.demux(b"".join(packets[:6] + packets[5:]))
    assert again.continuity_errors == 0 and b"".join(u.data for u in again.units) == bytes(range(256)) * 200
    assert transport.demux(media[:-3] + b"\0").lost == 1
    assert transport.demux(b"\0" + packets[0][1:] + b"".join(packets[1:])).lost == 1
    broken = bytearray(media)
    broken[12] ^= 1
    assert transport.demux(bytes(broken)).table_errors == 1
    assert transport.demux(b"").units == []


def test_transport_rows(odd, empty):
    rows = transport.digest_documents(odd).collect()
    assert len(rows) == odd.count() and all(r.payload_bytes % 64 == 0 and r.payload_bytes >= max(64, r.n_bytes) for r in rows)
    stored = transport.store_documents(odd, keep=("doc_id", "score"))
    units = transport.access_units(stored).collect()
    assert all(u.complete and u.random_access for u in units) and max(u.ordinal for u in units) > 0
    assert transport.digest_documents(empty).count() == 0


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum((int(c) * (1 + i % 2) - 9 * (i % 2 and int(c) > 4)) for i, c in enumerate(reversed(digits))) % 10 == 0


def valid(kind, x):
    digits = re.sub("[^0-9]", "", x)
    return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in x.split(".")), "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]


def test_personal_data_equals_brute_force(spark):
    random.seed(8)
    bits = ["1", "2", "0", "255", ".", " ", "-", "+", "@", "a", "é", "😀", "4111111111111111", "(", ")", "\n", "x.y@z.com", "10.0.0.1", "+1 555 123 4567"]
    texts = [None, "", "1 " * 20000, "7" * 30000, "a@b.c " * 500] + ["".join(random.choice(bits) for _ in range(random.randint(0, 50))) for _ in range(600)]
    rows = pii.digest_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in rows:
        spans = [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, texts[r.doc_id] or "") if valid(k, m[0])]
        assert [s for s in r.spans.split(",") if s and not s.startswith("iban")] == spans
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s.startswith(k) for s in spans) for k in PATTERNS)


def test_accounts_context_and_masks(spark, odd, empty):
    df = spark.createDataFrame([(1, "iban DE89370400440532013000 ok", 1), (2, "DE89370400440532013001", 2), (3, "card 4111111111111111", 3), (4, "order 4111111111111111", 4)], "doc_id long, text string, email int")
    rows = {r.doc_id: r for r in pii.find_personal_data(df).collect()}
    assert len(rows[1].iban) == 1 and not rows[2].iban
    assert rows[3].card[0].score == 1.0 and rows[4].card[0].score == 0.5
    assert {r.doc_id: r.text for r in pii.masked(df).collect()}[3] == "card <card>"
    assert pii.digest_documents(odd).count() == odd.count() and pii.digest_documents(empty).count() == 0


def test_pii_plan_is_native(odd):
    plan = pii.digest_documents(odd)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan.split("== Physical Plan ==")[1])


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65])
def test_padding(n):
    assert len(transport.padded(b"x" * n)) == max(64, -(-n // 64) * 64)


def test_rounds_of_long_words_equal_library():
    random.seed(21)
    p = bpe.pieces(PATH)
    letters = [c for c in "abcdefghijklmnopqrstuvwxyzABCDEFXYZ0123456789+/=_-" if p.kind[ord(c)]]
    words = ["".join(random.choices(letters[: random.choice([2, 3, 5, 26, 50])], k=n)) for n in (257, 300, 513, 1000, 4000) for _ in range(6)]
    words += ["a" * 5001, "ab" * 3000, "the" * 2000, "=" * 700, "aab" * 900, "".join(random.choices(letters, k=60_000))]
    same_as_library(words)
    for text in words[:20]:
        symbols = p.symbol[p.kind[np.array([ord(c) for c in text])]]
        rounds, _ = bpe._rounds(p, symbols, np.array([0]), np.array([len(symbols)]))
        assert rounds.tolist() == bpe._long_rounds(p, symbols).tolist()


def test_transport_digests_equal_plain_python(spark):
    texts = [None, "", "x", "é" * 40, "abc" * 9000]
    rows = {r.doc_id: r for r in transport.digest_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for k, text in enumerate(texts):
        raw = (text or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        media = transport.mux(payload)
        assert (rows[k].n_bytes, rows[k].payload_bytes, rows[k].media_bytes) == (len(raw), len(payload), len(media)) and len(media) % 188 == 0
        assert rows[k].payload_sha256 == hashlib.sha256(payload).hexdigest() and rows[k].media_sha256 == hashlib.sha256(media).hexdigest()
        assert rows[k].tail_crc32 == zlib.crc32(payload[-64:])


def test_clock_references():
    media = transport.mux(os.urandom(70_000))
    packets = [media[k : k + 188] for k in range(0, len(media), 188)]
    begins = [x for x in packets if x[1] & 0x40 and (x[1] & 31) << 8 | x[2] == transport.DATA_PID]
    for k, x in enumerate(begins):
        field = x[6:12]  # base of 33 bits, six reserved bits, extension of nine bits
        base = field[0] << 25 | field[1] << 17 | field[2] << 9 | field[3] << 1 | field[4] >> 7
        assert x[5] & 0x50 == 0x50 and x[4] >= 7 and base == 3600 * k and field[4] & 0x7E == 0x7E and field[5] == 0
    assert [u.clock for u in transport.demux(media).units] == [3600 * k for k in range(len(begins))]


def test_personal_data_in_long_runs(spark):
    runs = ["a" * 1_000_000 + " x@y.zz", "a" * 1_000_000 + "@", "7" * 1_000_000 + ".", "1." * 500_000, "+1" + "-" * 1_000_000, ("ab@" * 300_000), "A1" * 500_000, "1.2.3.4 " * 100_000]
    for k, text in enumerate(runs):
        df = spark.createDataFrame([(k, text + " user@host.org")], "doc_id long, text string")
        began = time.perf_counter()
        row = pii.digest_documents(df).collect()[0]
        assert row.n_email >= 1 and time.perf_counter() - began < 10, (k, time.perf_counter() - began)
        spans = [f"{n}:{m.start()}:{m.end()}" for n, p in LINEAR.items() for m in re.finditer(p, text + " user@host.org") if valid(n, m[0])]
        assert row.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()


#: The same matches as PATTERNS, found in linear time.
LINEAR = {"email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)++", "ip": r"(?<![0-9])[0-9]++(\.[0-9]++){3}", "card": r"[0-9](?:[\x20-]?[0-9])++", "phone": PATTERNS["phone"]}


def test_matches_after_a_match(spark):
    texts = ["a@b.c_d@e.f", "a@b.c%x@y.z.", "1.2.3.4.5.6.7.8", "a@b.cd@e.f", "1.2.3.4@b.c"] * 3
    rows = pii.digest_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in rows:
        assert [x for x in r.spans.split(",") if x] == [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, texts[r.doc_id]) if valid(k, m[0])]


def packet(pid, count, payload, start=False, flags=0, secret=0):
    """A packet whose payload fills it."""
    assert len(payload) == 184
    return bytes([transport.SYNC, flags | (0x40 if start else 0) | pid >> 8, pid & 255, secret << 6 | 0x10 | count & 15]) + payload


def long_map(described=200):
    """A program map table with a long descriptor."""
    pid = transport.DATA_PID
    body = bytes([0xE0 | pid >> 8, pid & 255, 0xF0 | described + 2 >> 8, described + 2 & 255, 0x80, described]) + b"d" * described
    return transport._section(2, 1, body + bytes([transport.PRIVATE_TYPE, 0xE0 | pid >> 8, pid & 255, 0xF0, 0]))


def units_after(table_packets, payload=b"unit" * 16):
    """What is found behind the first table and these packets of the second."""
    packets = [transport._tables()[0].tobytes(), *table_packets, *(transport.mux(payload)[k : k + 188] for k in range(376, len(transport.mux(payload)), 188))]
    return transport.demux(b"".join(packets))


def test_tables_over_several_packets():
    table, pid = long_map(), transport.MAP_PID
    first = packet(pid, 0, b"\0" + table[:183], True)
    plain = packet(pid, 1, table[183:].ljust(184, b"\xff"))
    # the rest stands before the next section, whose place the pointer field tells
    rest = table[183:]
    pointed = packet(pid, 1, bytes([len(rest)]) + rest + table[: 183 - len(rest)], True)
    last = packet(pid, 2, table[183 - len(rest) :].ljust(184, b"\xff")[:184])
    for packets in ([first, plain], [first, first, plain, plain], [first, pointed, last]):
        found = units_after(packets)
        assert found.streams == {transport.DATA_PID: transport.PRIVATE_TYPE} and found.table_errors == 0
        assert [u.data for u in found.units] == [b"unit" * 16]
    gone = units_after([first, packet(pid, 2, plain[4:])])  # the second packet's counter has jumped
    assert gone.streams == {} and gone.table_errors == 1 and gone.units == []


def test_damaged_and_scrambled_packets():
    media = transport.mux(b"x" * 1000)
    packets = [media[k : k + 188] for k in range(0, len(media), 188)]
    damaged = [*packets[:3], bytes([packets[3][0], packets[3][1] | 0x80]) + packets[3][2:], *packets[4:]]
    found = transport.demux(b"".join(damaged))
    assert found.lost == 1 and found.continuity_errors == 1 and not found.units[0].complete
    secret = [*packets[:2], *(p[:3] + bytes([p[3] | 0xC0]) + p[4:] for p in packets[2:])]
    found = transport.demux(b"".join(secret))
    assert found.scrambled == len(packets) - 2 and found.units == [] and found.continuity_errors == 0
