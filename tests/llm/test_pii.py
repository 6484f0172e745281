import re
import time

import numpy as np
import pytest

from pipewright.llm import pii, queries, trees
from tests.llm.helpers import DATA, SCHEMA, documents, odd


@pytest.fixture(scope="module")
def model():
    return pii.fit()


def test_trees_learn_an_interaction():
    r = np.random.default_rng(0)
    x = r.standard_normal((3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    m = trees.fit(x[:2000], y[:2000], trees=30, depth=3)
    assert np.mean((m.margin(x[2000:]) > 0) == y[2000:]) > 0.95


def test_held_out_quality(model):
    g = pii.Generator(777)
    right = wrong = missed = 0
    for _ in range(600):
        text, truth = g.example()
        found = {(k, a, b) for a, b, k, _ in pii.find_all([text], model)[0]}
        right += len(found & set(truth))
        wrong += len(found - set(truth))
        missed += len(set(truth) - found)
    assert right / (right + wrong) > 0.97 and right / (right + missed) > 0.97


def test_known_formats(model):
    text = 'Write to anna.lee@mail3.example.com or call +1 (415) 555-0199, host 10.20.30.40, card 4111111111111111, ssn 123-45-6789, token = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8" please.'
    found = pii.find_all([text], model)[0]
    assert [k for _, _, k, _ in found] == ["email", "phone", "ip", "card", "ssn", "secret"]
    redacted = pii.redact(text, found)
    assert redacted.startswith("Write to [EMAIL] or call [PHONE], host [IP], card [CARD],") and 'token = "[SECRET]" please.' in redacted


@pytest.mark.parametrize("text", ["The card 4111111111111112 is no card.", "On 2024-01-15 the 1,234,567 people left.", "version 1.2.3.4 of chapter 12", "commit 9b0b3c6a43eb78aa99cbd7049c572391524f37a8 fixes it", "plain words only, and 42 of them"])
def test_clean_texts(model, text):
    assert pii.find_all([text], model) == [[]]


def test_select_resolves_overlaps(model):
    one = [("phone", 0, 10), ("card", 2, 8), ("ip", 20, 25)]
    chosen = pii.select(one, np.array([0.99, 0.999, 0.1]), pii.Model(model.trees, 1, 0, {k: 0.5 for k in pii.KINDS}))
    assert chosen == [(2, 8, "card", 0.999)]


def test_check_digits():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.iban_ok("DE89370400440532013000") and not pii.iban_ok("DE88370400440532013000")


def test_odd_rows(spark, model):
    table = odd(spark)
    assert pii.redactions(table, model).count() == 0
    mail = "me@example.com"
    docs = documents(spark, [(None, mail), (1, "x " * 300_000 + mail), (2, mail), (2, mail), (3, None), (4, ""), (5, "é😀 " + mail)])
    got = pii.redactions(docs, model).collect()
    assert sorted(r["doc_id"] or 0 for r in got) == [0, 1, 2, 2, 5]
    last = next(r for r in got if r["doc_id"] == 5)
    assert last["redactions"][0]["start"] == 3 and last["redacted"] == "é😀 [EMAIL]"
    assert pii.redactions(spark.createDataFrame([], SCHEMA), model).count() == 0


@pytest.mark.parametrize(
    ("text", "kind", "span"),
    [
        ("my card 4111 1111 1111 1111 12/27 please", "card", "4111 1111 1111 1111"),
        ("my card 4111111111111111 123 please", "card", "4111111111111111"),
        ("pay to iban DE89 3704 0044 0532 0130 00 BIC COBADEFF soon", "iban", "DE89 3704 0044 0532 0130 00"),
        ("phone: 415-555-0199 2 times", "phone", "415-555-0199"),
        ("login from 2001:db8::8a2e:370:7334 today", "ip", "2001:db8::8a2e:370:7334"),
        ("host: fe80:12:ab34:9c1:77f0:2d:1a2b:c3d4 today", "ip", "fe80:12:ab34:9c1:77f0:2d:1a2b:c3d4"),
    ],
)
def test_data_before_numbers_and_ipv6(model, text, kind, span):
    a = text.index(span)
    assert (kind, a, a + len(span)) in pii.candidates(text)
    assert [(k, text[s:e]) for s, e, k, _ in pii.find_all([text], model)[0]] == [(kind, span)]


def test_times_are_no_addresses(model):
    assert pii.find_all(["it rang at 12:34:56 and at 7:08:09"], model) == [[]]


def test_long_runs_take_time_in_proportion(model):
    for sign in ("a", "7", "a.", "a1", ":", "- ", "@", "a@", "4 ", "A1 ", "éa.", "key="):
        text = sign * (60_000 // len(sign))
        began = time.time()
        pii.candidates(text)
        assert time.time() - began < 20, sign
    key = "x" * 300 + "9" + "y" * 40
    assert ("secret", 4, 4 + len(key)) in pii.candidates("see " + key + " there")


def every_span(text):
    """The candidates of kinds with patterns, from all spans of a text of up to 60 signs."""
    out = set()
    for kind in ("phone", "card", "iban", "ssn"):
        for a in range(len(text)):
            for b in range(a + 5, min(len(text), a + 60) + 1):
                if text[b - 1] not in ".-" and pii.GENERATORS[kind].fullmatch(text, a, b) and not re.match(r"\w", text[b : b + 1]) and pii.GENERATORS[kind].match(text, a):
                    out.add((kind, a, b))
    return out


def test_query_against_brute_force(spark, model):
    """Text by text: every admissible span is proposed, each is scored alone, and the likeliest are taken one by one."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {r["doc_id"]: [(s["start"], s["end"], s["kind"]) for s in r["redactions"]] for r in queries.op3_pii(spark, DATA).collect()}
    want = {}
    for r in docs.collect():
        text = r["text"] or ""
        spans = pii.candidates(text)
        if len(text) < 1500:
            assert {s for s in every_span(text) if s[0] in ("phone", "card", "iban")} <= set(spans)
        scored = [(float(model.probability(np.array([pii.features(text, *s)]))[0]), s) for s in spans]
        scored = sorted(((p, b - a, -a, k, b) for p, (k, a, b) in scored if p >= model.threshold[k]), reverse=True)
        taken = []
        for _, n, minus, k, b in scored:
            if all(b <= s or e <= -minus for s, e, _ in taken):
                taken.append((-minus, b, k))
        if taken:
            want[r["doc_id"]] = sorted(taken)
    assert want and got == want
