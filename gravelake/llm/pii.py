"""Personal data by weak supervision.

Base spans (email, ip, card, phone) are fixed patterns with checks.  Further
candidates come from looser patterns: secrets, written-out addresses, local
phone numbers, account numbers, names.  On every candidate regex, gazetteer and
context labelers vote for, against or not at all.  Counts of (kind, votes,
features) over the whole corpus are all that leaves the tasks; there are at
most ``PATTERNS`` different ones.  Expectation-maximisation estimates from them
how reliable each labeler is, and its posteriors train a logistic classifier on
the features; candidates that it accepts are added to the base spans.

Defined results: null text counts as empty (no spans); an added span never
overlaps a base span or an earlier added one; rows are independent; other
columns are ignored by ``find_spans`` and kept by ``mask``; an empty table
gives an empty table and a model that accepts nothing.  Work is linear in a
text's length, also for long runs of letters or digits: addresses are looked
for outward from each ``@``, numbers with dots by whole chains of digits.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._store import materialise, text_columns

BASE = ("email", "ip", "card", "phone")
ADDED = ("secret", "written_email", "local_phone", "account", "name")
KINDS = BASE + ADDED

_LOCAL_PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")

#: Looser patterns for the further kinds; each is looked for only in texts that hold what it must contain.
SECRET = re.compile(r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*[0-9])[A-Za-z0-9_-]{20,}(?![A-Za-z0-9_-])")
WRITTEN = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+ ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]+(?: ?(?:[\[(] ?dot ?[\])]|\.) ?[A-Za-z0-9-]+)+", re.I)
LOCAL = re.compile(r"(?<![0-9+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9.-])")
ACCOUNT = re.compile(r"(?<![0-9A-Za-z])(?:[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}|[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{9,19})(?![0-9A-Za-z])")
NAME = re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Señor|Señora|Madame|Monsieur)\.? [A-Z][a-zà-ÿ]+(?: [A-Z][a-zà-ÿ]+)?|\b(?:[Mm]y name is|[Ii]ch heiße|[Jj]e m'appelle|[Mm]e llamo) [A-Z][a-zà-ÿ]+(?: [A-Z][a-zà-ÿ]+)?")

#: Gazetteers: given names, ends of host names, first digits of card schemes.
GIVEN = frozenset("James John Robert Michael William David Richard Joseph Thomas Charles Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Anna Maria Peter Paul Hans Karl Klaus Jürgen Sabine Petra Jean Pierre Marie Louis Claire Luis José Juan Carmen Ana Carlos".split())
HOST_ENDS = frozenset("com org net edu gov io de fr es uk eu info biz".split())
SCHEMES = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65")
#: Words that speak for a kind, and words that speak against any.
FOR = {
    "secret": re.compile(r"token|secret|key|password|passwd|pwd|bearer|auth|credential|session", re.I),
    "written_email": re.compile(r"mail|contact|write|kontakt|correo|courriel", re.I),
    "local_phone": re.compile(r"phone|tel|call|fax|mobile|cell|telefon|teléfono|téléphone|\bext\b", re.I),
    "account": re.compile(r"iban|account|konto|cuenta|compte|ssn|social security|passport|\bcard\b|\bacct\b", re.I),
    "name": re.compile(r"name|dear|sincerely|regards|signed|author|contact", re.I),
}
AGAINST = re.compile(r"version|licen[sc]e|isbn|issn|doi|commit|sha\b|checksum|md5|hash|page|figure|table|https?:|www\.|uuid", re.I)
#: Characters before a span that context labelers read.
CONTEXT = 40

LABELERS = ("shape", "gazetteer", "context_for", "context_against", "spread")
_FEATURES = 8
#: Different patterns that can leave the tasks: 5 kinds, 3**5 votes, 2**8 features.
PATTERNS = len(ADDED) * 3 ** len(LABELERS) * 2**_FEATURES


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Addresses, leftmost and non-overlapping.  Neither side of an ``@`` can hold another, so each one is tried once, with all of its left side that no earlier address took."""
    taken, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > taken and text[start - 1] in _LOCAL_PART:
            start -= 1
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            taken = host.end()
            yield start, taken
        else:
            taken = max(taken, at + 1)
        at = text.find("@", taken)


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Four numbers joined by dots, leftmost and non-overlapping: chains are taken whole and dealt out by fours; those with a part over 255 are dropped."""
    for chain in _CHAIN.finditer(text):
        parts = chain[0].split(".")
        start = chain.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(v) <= 3 and int(v or 0) <= 255 for v in (p.lstrip("0") for p in four)):
                yield start, end
            start = end + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the base kinds, sorted."""
    out = []
    if "@" in text:
        out += [(a, 0, b) for a, b in emails(text)]
    if _DIGIT.search(text):
        if "." in text:
            out += [(a, 1, b) for a, b in addresses(text)]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = _NOT_DIGIT.sub("", m[0])
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(out)


def _spread(piece: str) -> int:
    """Different characters of a piece in sixteenths of its length, 0 to 16."""
    return min(16, 16 * len(set(piece)) // max(1, min(len(piece), 16)))


def _votes(kind: str, text: str, start: int, end: int) -> tuple[list[int], int]:
    """Votes of the labelers (-1, 0, 1) and the candidate's feature bits."""
    piece, before = text[start:end], text[max(0, start - CONTEXT) : start]
    digits = sum(c.isdigit() for c in piece)
    letters = sum(c.isalpha() for c in piece)
    vote_for, vote_against = bool(FOR[kind].search(before)), bool(AGAINST.search(before))
    quoted = bool(before.rstrip()[-1:] in "\"'=:" and before.strip())
    if kind == "secret":
        shape = 1 if len(piece) in (32, 40, 64) and all(c in "0123456789abcdefABCDEF" for c in piece) or (digits >= 3 and letters >= 3 and piece != piece.lower()) else -1 if "-" in piece.strip("-") or digits < 3 else 0
        listed = 1 if piece.startswith(("sk-", "ghp_", "AKIA", "xox", "eyJ")) else 0
    elif kind == "written_email":
        shape, listed = 1, 1 if re.split(r"[^A-Za-z0-9]+", piece)[-1].lower() in HOST_ENDS else -1
    elif kind == "local_phone":
        shape, listed = 1 if piece[:1] == "(" or len({c for c in piece if not c.isalnum()}) == 1 else 0, -1 if "555" not in piece and piece[:1] in "01" else 0
    elif kind == "account":
        shape = 1 if letters == 2 or "-" in piece else -1
        listed = 1 if piece.startswith(SCHEMES) and luhn(_NOT_DIGIT.sub("", piece) or "1") else -1 if digits == len(piece) else 0
    else:
        shape, listed = 1, 1 if any(w in GIVEN for w in piece.split()) else 0
    spread = _spread(piece)
    votes = [shape, listed, 1 if vote_for else 0, -1 if vote_against else 0, 1 if spread >= 9 else -1 if spread <= 4 else 0]
    bits = [vote_for, vote_against, quoted, digits * 4 >= len(piece), letters * 4 >= len(piece), len(piece) >= 32, spread >= 9, shape > 0]
    return votes, sum(b << i for i, b in enumerate(bits))


def pattern_code(kind: int, votes: list[int], features: int) -> int:
    code = kind
    for v in votes:
        code = code * 3 + v + 1
    return code << _FEATURES | features


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """``(start, kind, end, pattern)`` of further candidates that overlap neither ``taken`` nor each other."""
    found: list[tuple[int, int, int]] = []
    if _DIGIT.search(text):
        found += [(m.start(), 0, m.end()) for m in SECRET.finditer(text)]
        found += [(m.start(), 2, m.end()) for m in LOCAL.finditer(text)]
        found += [(m.start(), 3, m.end()) for m in ACCOUNT.finditer(text)]
    low = text.lower() if "(" in text or "[" in text else ""
    if low and ("at)" in low or "at]" in low or "at )" in low or "at ]" in low):
        found += [(m.start(), 1, m.end()) for m in WRITTEN.finditer(text)]
    if any(w in text for w in ("Mr", "Ms", "Dr", "Prof", "Herr", "Frau", "Señor", "Madame", "Monsieur", "name is", "heiße", "appelle", "llamo")):
        found += [(m.start(), 4, m.end()) for m in NAME.finditer(text)]
    out, last = [], -1
    begins = [s for s, *_ in taken]  # ascending
    reach = list(accumulate((e for *_, e in taken), max))
    for start, kind, end in sorted(found, key=lambda x: (x[0], -x[2], x[1])):
        before = bisect_left(begins, end)
        if start >= last and not (before and reach[before - 1] > start):
            out.append((start, kind, end, pattern_code(kind, *_votes(ADDED[kind], text, start, end))))
            last = end
    return out


class Model:
    """Labelers' reliabilities and the span classifier, fitted to pattern counts."""

    def __init__(self, counts: dict[int, int], rounds: int = 30, steps: int = 60):
        codes = np.array(sorted(counts), np.int64)
        self.codes, weight = codes, np.array([counts[c] for c in codes.tolist()], float)
        self.accepted: list[int] = []
        if not len(codes):
            return
        bits, rest = codes & ((1 << _FEATURES) - 1), codes >> _FEATURES
        votes = np.empty((len(codes), len(LABELERS)), np.int64)
        for j in range(len(LABELERS) - 1, -1, -1):
            votes[:, j], rest = rest % 3, rest // 3
        kind = rest
        score = (votes - 1).sum(1)
        post = np.where(score > 0, 0.9, np.where(score < 0, 0.1, 0.3))
        # Votes at random would split as the prior does; a labeler is taken to be right more often than wrong.
        prior_true, prior_false = np.array([1.0, 4.0, 8.0]), np.array([8.0, 4.0, 1.0])
        for _ in range(rounds):
            share = np.array([(weight * post)[kind == k].sum() for k in range(len(ADDED))])
            total = np.array([weight[kind == k].sum() for k in range(len(ADDED))])
            base = (share + 1) / (total + 3)
            log = np.log(base[kind]) - np.log1p(-base[kind])
            self.reliability = np.empty((len(LABELERS), 2, 3))
            for j in range(len(LABELERS)):
                yes = np.bincount(votes[:, j], weight * post, 3) + prior_true
                no = np.bincount(votes[:, j], weight * (1 - post), 3) + prior_false
                self.reliability[j] = yes / yes.sum(), no / no.sum()
                voted = votes[:, j] != 1  # silence says nothing
                ratio = np.log(self.reliability[j, 0] / self.reliability[j, 1])
                log = log + np.where(voted, ratio[votes[:, j]], 0)
            post = 1 / (1 + np.exp(-np.clip(log, -30, 30)))
        self.posterior = post
        x = np.concatenate([np.eye(len(ADDED))[kind], (bits[:, None] >> np.arange(_FEATURES)) & 1], 1).astype(float)
        beta = np.zeros(x.shape[1])
        for _ in range(steps):  # Newton steps of the penalised likelihood
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            gradient = x.T @ (weight * (post - p)) - 0.5 * beta
            curve = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 0.5 * np.eye(x.shape[1])
            move = np.linalg.solve(curve, gradient)
            beta += np.clip(move, -1, 1)
            if np.abs(move).max() < 1e-9:
                break
        self.beta, self.kind = beta, kind
        self.probability = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        self.accepted = codes[self.probability >= 0.5].tolist()


_SPAN = T.StructType([T.StructField(n, T.IntegerType()) for n in ("start", "kind", "end")])


def _detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.struct([(n, pa.int32()) for n in ("start", "kind", "end")])
    extra = pa.struct([(n, pa.int32()) for n in ("start", "kind", "end", "pattern")])
    for batch in batches:
        base, more = [], []
        for text in batch.column(1):
            t = text.as_py() or ""
            own = base_spans(t)
            base.append([dict(zip(("start", "kind", "end"), x, strict=True)) for x in own])
            more.append([{"start": s, "kind": len(BASE) + k, "end": e, "pattern": p} for s, k, e, p in candidates(t, own)])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, pa.list_(span)), pa.array(more, pa.list_(extra))], names=["doc_id", "base", "more"])


def detect(docs: DataFrame) -> DataFrame:
    """``doc_id, base, more``: base spans and candidates of every row."""
    rows = text_columns(docs, "doc_id", "text")
    extra = T.StructType([*_SPAN.fields, T.StructField("pattern", T.IntegerType())])
    return rows.mapInArrow(_detect, T.StructType([rows.schema["doc_id"], T.StructField("base", T.ArrayType(_SPAN)), T.StructField("more", T.ArrayType(extra))]))


def fit(detected: DataFrame) -> Model:
    """The model of a corpus; at most ``PATTERNS`` counts come to the driver."""
    counts = detected.select(F.explode("more.pattern").alias("pattern")).groupBy("pattern").count().collect()
    return Model({r["pattern"]: r["count"] for r in counts})


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def _accept(codes: tuple[int, ...]):
    """Rows of ``detect`` with the accepted ones of ``more``, as spans, in ``added``."""
    yes = np.array(codes, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            more = batch.column(2)
            offsets = more.offsets.to_numpy()
            inner = more.values
            good = np.isin(inner.field("pattern").to_numpy(zero_copy_only=False), yes)
            good[: offsets[0]] = good[offsets[-1] :] = False
            kept = np.concatenate([[0], np.cumsum(good)])[offsets]
            names = ("start", "kind", "end")
            spans = pa.StructArray.from_arrays([inner.field(n).filter(pa.array(good)) for n in names], names=list(names))
            added = pa.ListArray.from_arrays(pa.array(kept - kept[0], pa.int32()), spans)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), added], names=["doc_id", "base", "added"])

    return run


def find_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base, spans, n_added``: spans as arrays of (start, kind, end), sorted."""
    found = materialise(detect(docs), "pii-spans")
    schema = T.StructType([found.schema["doc_id"], found.schema["base"], T.StructField("added", T.ArrayType(_SPAN))])
    judged = found.mapInArrow(_accept(tuple(fit(found).accepted)), schema)
    number = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return judged.select("doc_id", *[number(i).alias(f"n_{k}") for i, k in enumerate(BASE)], "base", F.array_sort(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"))


@lru_cache(maxsize=2)
def _accepted_set(codes: tuple[int, ...]) -> frozenset[int]:
    return frozenset(codes)


def masked(text: str, accepted: frozenset[int]) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans go together, under the first one's kind."""
    base = base_spans(text)
    spans = sorted(base + [(s, len(BASE) + k, e) for s, k, e, p in candidates(text, base) if p in accepted])
    if not spans:
        return text
    out, at, i = [], 0, 0
    while i < len(spans):
        start, kind, end = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] < end:
            end = max(end, spans[i][2])
            i += 1
        out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def mask(docs: DataFrame) -> DataFrame:
    """The input's rows, all columns, with personal data in ``text`` replaced.

    Two scans: one fits the model to the corpus, one replaces, so that texts
    are neither shuffled nor joined.
    """
    codes = tuple(fit(detect(docs)).accepted)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        accepted = _accepted_set(codes)
        for batch in batches:
            texts = pa.array([None if t.as_py() is None else masked(t.as_py(), accepted) for t in batch.column(at)], batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([texts if i == at else c for i, c in enumerate(batch.columns)], schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def op4_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data in all documents, spans written as ``kind:start:end``."""
    found = find_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"))
