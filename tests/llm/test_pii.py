"""Base spans by hand, votes and fitting, masking."""

import hashlib
import random
import re
import time

import numpy as np
import pytest

from gravelake.llm import pii

from .conftest import odd_rows


def spans(text):
    return [f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in pii.base_spans(text)]


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn_by_table(digits):
    return sum(int(d) if i % 2 == 0 else [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][int(d)] for i, d in enumerate(digits[::-1])) % 10 == 0


def contract_spans(text):
    """The contract's patterns and checks, word for word, without the module under test."""
    out = []
    for order, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = [c for c in m[0] if c in "0123456789"]
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                "card": 14 <= len(digits) <= 19 and luhn_by_table(digits),
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), order, kind, m.end()))
    return [f"{kind}:{start}:{end}" for start, _, kind, end in sorted(out)]


def test_base_spans_as_the_contract_says():
    rng = random.Random(11)
    for alphabet in ("aé@@..-_ 1", "1259.. a", "0123456789 -.", "+1234567890 ().-", "a@b.c+1 (2).3-4"):
        for _ in range(20000):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 24)))
            assert spans(text) == contract_spans(text), text
    assert spans("4111111111111111, 5500005555555559 x") == contract_spans("4111111111111111, 5500005555555559 x") != []


@pytest.mark.parametrize("text", ["x" * 10**6 + "@", "1" * 10**6 + ".", "0" * 10**4 + "1.2.3.4", "a" * 10**6 + " (at) ", "1.1.1.1 " * 10**5, "+1" + "(" * 10**6, "a1" * 10**6])
def test_long_runs_are_linear(text):
    began = time.process_time()
    pii.candidates(text, pii.base_spans(text))
    assert time.process_time() - began < 6


def test_base_kinds():
    assert spans("é a.b@c.example.com, x") == ["email:2:19"]
    assert spans("1.2.3.4 and 256.1.1.1 and 10.20.30.255.") == ["ip:0:7", "ip:26:38"]
    assert spans("4111 1111 1111 1111 / 4111-1111-1111-1112") == ["card:0:19"]
    assert spans("+1 (017) 555-7713 +12 34") == ["phone:0:17"]
    assert spans("") == [] and spans("no data 12345") == []
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_added_spans_do_not_touch_base():
    text = 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" x@y.example.org 4111111111111111'
    base = pii.base_spans(text)
    more = pii.candidates(text, base)
    assert [(s, pii.ADDED[k], e) for s, k, e, _ in more] == [(9, "secret", 49)]


def test_fit_separates():
    corpus = ['api token = "%040x"' % (i * 0x123456789ABCDEF0123456789ABCDEF01234567 % (1 << 160)) for i in range(1, 60)]
    corpus += [f"isbn page {10**12 + i * 7919}" for i in range(60)] + ["call me on 555-123-4567", "see hash %032x" % (3**80)]
    counts = {}
    for t in corpus:
        for *_, p in pii.candidates(t, pii.base_spans(t)):
            counts[p] = counts.get(p, 0) + 1
    model = pii.Model(counts)
    yes = frozenset(model.accepted)
    assert all(pii.masked(t, yes) == 'api token = "[SECRET]"' for t in corpus[:59])
    assert all(pii.masked(t, yes) == t for t in corpus[59:119])
    assert pii.Model({}).accepted == []


def test_operator(odd, nothing, with_repeats):
    texts = {r[0]: r[1] or "" for r in odd_rows()}
    rows = pii.find_spans(odd).collect()
    assert len(rows) == len(texts)
    for r in rows:
        own = contract_spans(texts[r.doc_id])
        written = [f"{pii.KINDS[s.kind]}:{s.start}:{s.end}" for s in r.base]
        assert written == own
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(x.startswith(k) for x in own) for k in PATTERNS)
        assert {(s.start, s.kind, s.end) for s in r.spans} >= {(s.start, s.kind, s.end) for s in r.base}
    assert pii.find_spans(nothing).count() == 0 and pii.mask(nothing).count() == 0
    assert pii.find_spans(with_repeats).count() == with_repeats.count()


def test_digests(spark):
    sf_dir = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = pii.op4_pii(spark, sf_dir).collect()
    for r in rows:
        assert r.base_sha256 == hashlib.sha256(",".join(contract_spans(texts[r.doc_id])).encode()).hexdigest()
        assert set(contract_spans(texts[r.doc_id])) <= set(filter(None, r.spans.split(",")))
    assert any("secret:" in r.spans for r in rows)


def test_mask(odd):
    before = {r.doc_id: r for r in odd.collect()}
    for r in pii.mask(odd).collect():
        old = before[r.doc_id]
        assert r.source == old.source and (r.text is None) == (old.text is None)
        if old.text:
            assert not pii.base_spans(r.text) and (("[" in r.text) == bool(pii.base_spans(old.text)))


def plain_em(counts, rounds=30):
    """Expectation-maximisation over (kind, votes) in dictionaries and loops; posteriors by pattern code."""
    items = []
    for code, n in sorted(counts.items()):
        rest, votes = code >> 8, []
        for _ in pii.LABELERS:
            rest, v = divmod(rest, 3)
            votes.insert(0, v)
        items.append((code, n, rest, votes))
    post = {c: 0.9 if sum(v) > len(v) else 0.1 if sum(v) < len(v) else 0.3 for c, _, _, v in items}
    for _ in range(rounds):
        base = {}
        for kind in range(len(pii.ADDED)):
            own = [(n, post[c]) for c, n, k, _ in items if k == kind]
            base[kind] = (sum(n * p for n, p in own) + 1) / (sum(n for n, _ in own) + 3)
        table = []
        for j in range(len(pii.LABELERS)):
            yes, no = [1.0, 4.0, 8.0], [8.0, 4.0, 1.0]
            for c, n, _, v in items:
                yes[v[j]] += n * post[c]
                no[v[j]] += n * (1 - post[c])
            table.append(([x / sum(yes) for x in yes], [x / sum(no) for x in no]))
        new = {}
        for c, _, kind, v in items:
            a, b = base[kind], 1 - base[kind]
            for j, vote in enumerate(v):
                if vote != 1:
                    a, b = a * table[j][0][vote], b * table[j][1][vote]
            new[c] = a / (a + b)
        post = new
    return post


def planted(rng):
    """(text, kind, span) with one true item of a kind, and (text, None, None) with a look-alike."""
    digit = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    mixed = lambda n: "".join(rng.choice("abcdefghABCDEFGH0123456789") for _ in range(n))
    local = lambda: f"({rng.randint(200, 899)}) {digit(3)}-{digit(4)}"
    name = lambda: f"{rng.choice(['James', 'Mary', 'Anna', 'Peter'])} {rng.choice(['Keller', 'Smith', 'Lopez'])}"
    true = {
        "secret": lambda: ("api token = ", mixed(36) + "A1b2C3"),
        "written_email": lambda: ("write to my mail ", f"{rng.choice(['jo', 'ann', 'max'])}{digit(2)} (at) example{digit(1)} (dot) com"),
        "local_phone": lambda: ("call my phone ", local()),
        "account": lambda: ("the iban is ", "DE" + digit(2) + "".join(" " + digit(4) for _ in range(4))),
        "name": lambda: ("signed, the author ", "Mr. " + name()),
    }
    false = [lambda: f"see isbn page {digit(13)} now", lambda: f"licence version checksum {'abc' * 5}-{digit(3)}-{'def' * 3} now", lambda: f"figure page {digit(10)} of the table", lambda: "the hash commit " + "-".join(["abcde1"] * 5)]
    rows = []
    for _ in range(60):
        for kind, make in true.items():
            before, item = make()
            rows.append((f"{before}{item} thanks", kind, (len(before), len(before) + len(item))))
        rows += [(make(), None, None) for make in false]
    return rows


def test_recall_and_precision_of_added_kinds():
    rows = planted(random.Random(5))
    counts, found = {}, []
    for text, _, _ in rows:
        own = pii.candidates(text, pii.base_spans(text))
        found.append(own)
        for *_, p in own:
            counts[p] = counts.get(p, 0) + 1
    model = pii.Model(counts)
    assert np.allclose(model.posterior, [plain_em(counts)[c] for c in model.codes.tolist()], atol=1e-6)
    yes, hits, right, wrong = set(model.accepted), {k: 0 for k in pii.ADDED}, 0, 0
    for (_, kind, span), own in zip(rows, found, strict=True):
        for start, k, end, p in own:
            if p in yes:
                good = pii.ADDED[k] == kind and (start, end) == span
                right, wrong = right + good, wrong + (not good)
                hits[pii.ADDED[k]] += good
    print({k: n / 60 for k, n in hits.items()}, right / (right + wrong))
    assert all(n >= 0.9 * 60 for n in hits.values()) and right >= 0.95 * (right + wrong)
