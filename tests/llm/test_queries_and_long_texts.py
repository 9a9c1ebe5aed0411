"""The registered queries against the contracts' words, row by row; and scanners on long texts of many matches."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib

import pytest
import xxhash
from conftest import SF

from admitlake.llm import licenses, pii, queries, secrets
from admitlake.llm.spans import Covered, Outermost


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


def secret_spans(text):
    out = [("assign", *m.span()) for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 8]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16] + [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return out


def personal_spans(text):
    only = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(only(m[0])) <= 19 and luhn(only(m[0]))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(only(m[0])) <= 15]


def digest(found, kinds):
    return sha(",".join(f"{k}:{a}:{b}" for k, a, b in sorted(found, key=lambda s: (s[1], kinds.index(s[0])))))


def fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text.translate({c: c + 32 for c in range(65, 91)})) if w]
    grams = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def rows(spark, name):
    return {r["doc_id"]: r for r in queries.QUERIES[name](spark, SF).collect()}


def test_op1_by_the_library(spark, texts):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=queries._model_path())
    for i, r in rows(spark, "op1_sentencepiece").items():
        ids = library.encode(texts[i])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))


def test_op3_reads_back_what_it_stored(spark, texts):
    found = rows(spark, "op3_motion_jpeg")
    for i, r in found.items():
        raw = texts[i].encode()
        payload = raw + b"\xff" * (-len(raw) % 576 or 576 * (not raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r["media_bytes"] > len(payload) // 20 and len(r["media_sha256"]) == 64 and r["feature"]
    same = [(texts[a] == texts[b], found[a]["media_sha256"] == found[b]["media_sha256"], found[a]["feature"] == found[b]["feature"]) for a in list(texts)[:40] for b in list(texts)[:40]]
    assert all(m and f for t, m, f in same if t)


@pytest.mark.parametrize(("name", "spans", "kinds"), [("op4_secrets", secret_spans, ["assign", "access", "hex"]), ("op7_personal_data", personal_spans, ["email", "ip", "card", "phone"])])
def test_base_spans_of_the_queries(spark, texts, name, spans, kinds):
    for i, r in rows(spark, name).items():
        want = spans(texts[i])
        assert [r[f"n_{k}"] for k in kinds] == [sum(s[0] == k for s in want) for k in kinds] and r["base_sha256"] == digest(want, kinds)
        listed = [s.rsplit(":", 2) for s in r["spans"].split(",") if s]
        assert {(k, str(a), str(b)) for k, a, b in want} <= {tuple(s) for s in listed} and [int(s[1]) for s in listed] == sorted(int(s[1]) for s in listed)


def test_op5_base_of_the_query(spark, texts):
    for i, r in rows(spark, "op5_licenses").items():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", texts[i].translate({c: c + 32 for c in range(65, 91)}))
        at = [(k, label) for p, label in licenses.PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        starts = [k for k, _ in at]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(at), min(starts, default=None), max(starts, default=None))
        assert r["base_labels"] == ",".join(sorted({label for _, label in at})) and {label for _, label in at} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_op8_fingerprints_and_components(spark, texts):
    found = rows(spark, "op8_simhash")
    prints = {i: fingerprint(t) for i, t in texts.items()}
    assert {i: r["fingerprint"] for i, r in found.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    group = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            least = min(group[b] for b in prints if (prints[a] ^ prints[b]).bit_count() <= 2)
            changed, group[a] = changed or least < group[a], min(least, group[a])
    assert {i: r["component_id"] for i, r in found.items()} == group


def test_op2_and_op6_cover_all_rows(spark, texts):
    assert rows(spark, "op2_language_id").keys() == texts.keys()
    for i, r in rows(spark, "op6_language_model").items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 1) and r["score"] < 0 and r["n_known"] <= r["n_tokens"]


def test_covered_and_outermost_are_what_all_comparisons_say():
    draw = random.Random(1)
    for _ in range(300):
        covered, outermost, spans, kept = Covered(), Outermost(), [], []
        for _ in range(25):
            a = draw.randrange(60)
            b = a + draw.randint(1, 12)
            assert covered.meets(a, b) == any(s < b and a < e for s, e in spans)
            assert outermost.holds(a, b) == any(s <= a and b <= e for s, e in kept)
            if not outermost.holds(a, b):
                outermost.add(a, b)
                kept.append((a, b))
            if draw.random() < 0.6:
                covered.add(a, b)
                spans.append((a, b))


def test_long_texts_take_seconds():
    began = time.time()
    notice = "copyright (c) 2019 some author, all rights reserved. licensed under the apache license, version 2.0\n"
    assert licenses.scan((notice * 20_000).encode())[0] == 20_000
    keys = "password = abcdef1234567890 and path/to-some_thing/else1234567890abcd\n" * 12_000
    assert sum(s[4] for s in secrets.scan([keys], secrets.trained(300))[0]) == 12_000
    people = "write to a.b@c.example.org or 10.0.0.1, call 555-123-4567 or 123-45-6789\n" * 30_000
    assert sum(s[4] for s in pii.scan(people)) == 60_000
    assert time.time() - began < 120
