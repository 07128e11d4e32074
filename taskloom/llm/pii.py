"""Personal data by weak supervision.

Four patterns give the *base* spans (email, ip, card, phone), exactly as ``BASE_RULES`` says.  Beside them
looser patterns propose candidates of the same kinds that a base pattern misses (``name at host dot com``,
a number after ``phone:``, a digit group with the right check digit), and of two further kinds, ``secret``
(values assigned to a word such as ``token``, long hexadecimal numbers, keys with a known beginning) and ``name`` (capitalised words
after a title).

Labelers vote on every candidate, base spans included: for, against, or not at all.  They look at the
pattern itself, at gazetteers (mail providers, top-level domains, given names and titles), at the words
before the candidate, at check digits and lengths, and at the characters next to it.  Spark counts the
vote patterns of each kind, and the span's *shape*, over all documents; there are at most 3^L times the 108 shapes, whatever the input.
Expectation-maximisation over those counts estimates each labeler's reliability for each kind and each pattern's
probability of being personal data.  A logistic classifier is then trained on those probabilities and decides on each candidate span.  It
sees the votes, their pairs and the kind, and what no labeler saw: the span's length, its shares of digits and of different characters, and whether
quotes or brackets enclose it.  Base spans always stay; other candidates
are added if their probability is ``THRESHOLD`` or more, they overlap no base span, and no surer one.

Cases: null and empty texts have no spans; offsets are code points, end exclusive; an empty table gives an
empty result and an untrained model, which adds nothing; repeated and null ``doc_id`` as in ``common``; all patterns
scan each text once, so very long texts take time in proportion to their length.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taskloom.llm.common import documents, table, written

KINDS = ("email", "ip", "card", "phone", "secret", "name")
THRESHOLD = 0.9

#: What the base spans are: leftmost non-overlapping matches; those that fail the test are dropped.
BASE_RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)  with parts of at most 255",
    "card": r"[0-9]([\x20-]?[0-9])+  with 16 to 19 digits that pass the Luhn test",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]  with 8 to 15 digits",
}
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only begin where its run of digits does: from inside the run it would fail as well.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

#: Candidates beyond the base; they have no upper lengths but those of mail addresses.
_SPELT = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\[(]?(?: at |@)[\])]? ?[A-Za-z0-9-]{1,63} ?[\[(]?(?: dot |\.)[\])]? ?[A-Za-z]{2,24}(?![A-Za-z0-9])")
_NUMBER = re.compile(r"(?<![A-Za-z0-9.+])\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-]?[0-9]{3,4}(?![A-Za-z0-9])")
_SECRET = re.compile(r"(?<![A-Za-z0-9_-])(?:sk|pk|AKIA|ghp|xox[bp])[A-Za-z0-9_-]{14,}+")
_ASSIGNED = re.compile(
    r"(?i)(?<![a-z0-9])(?:api[_-]?key|access[_-]?key|private[_-]?key|client[_-]?secret|secret|token|password|passwd|pwd|auth|bearer)[\"']?\s{0,3}(?:[:=]|\s)\s{0,3}[\"']?"
    r"([a-z0-9+/_.~=-]{12,}+)"
)
_HEX = re.compile(r"(?<![A-Za-z0-9])(?:[a-f0-9]{32,}+|[A-F0-9]{32,}+)(?![A-Za-z0-9])")
_NAME = re.compile(r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.? [A-Z]\w++(?: [A-Z]\w++)?")

PROVIDERS = frozenset({"gmail", "yahoo", "hotmail", "outlook", "icloud", "protonmail", "gmx", "mail", "example"})
TOP_LEVEL = frozenset({"com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "info", "test"})
GIVEN = frozenset({"james", "mary", "john", "anna", "maria", "peter", "jean", "marie", "hans", "jose", "carlos", "lucia", "paul", "laura", "thomas", "julia"})
CUES = {
    "email": frozenset({"email", "e-mail", "mail", "contact", "write", "reach", "correo", "courriel"}),
    "ip": frozenset({"ip", "address", "host", "server", "from", "client", "login"}),
    "card": frozenset({"card", "visa", "mastercard", "credit", "carte", "karte", "tarjeta", "payment"}),
    "phone": frozenset({"phone", "tel", "telephone", "call", "mobile", "fax", "telefon", "fon"}),
    "secret": frozenset({"key", "token", "secret", "password", "apikey", "api_key", "bearer"}),
    "name": frozenset({"name", "dear", "by", "from", "signed", "contact"}),
}
AGAINST = frozenset({"version", "v", "isbn", "section", "page", "figure", "line", "copyright", "rfc", "license"})
LABELERS = ("pattern", "gazetteer", "cue", "check", "edges")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base spans, by kind as listed and then by start."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


def more_spans(text: str) -> list[tuple[str, int, int]]:
    """Candidates of the looser patterns."""
    out = []
    if "@" in text or " at " in text:
        out += [("email", *m.span()) for m in _SPELT.finditer(text)] if " dot " in text or "@" in text else []
    if _DIGIT.search(text):
        out += [("phone", *m.span()) for m in _NUMBER.finditer(text)]
        secrets = {m.span() for m in _SECRET.finditer(text)} | {m.span(1) for m in _ASSIGNED.finditer(text)} | {m.span() for m in _HEX.finditer(text)}
        out += [("secret", a, b) for a, b in sorted(secrets) if _DIGIT.search(text, a, b)]
    return out + [("name", *m.span()) for m in _NAME.finditer(text) if not (m.start() and text[m.start() - 1].isalnum())]


def apart(spans: list[tuple[str, int, int]], taken: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int]]:
    """The spans that overlap none of those taken."""
    merged: list[list[int]] = []
    for _, a, b in sorted(taken, key=lambda x: x[1:]):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    starts = [a for a, _ in merged]
    for kind, a, b in spans:
        i = bisect_left(starts, b) - 1  # the last that begins before this one ends
        if i < 0 or merged[i][1] <= a:
            yield kind, a, b


def chained(spans: list[tuple[str, int, int]]) -> Iterator[tuple[int, str, int, int]]:
    """The spans with a number that those of a chain of overlapping ones share."""
    chain, reach = -1, -1
    for kind, a, b in sorted(spans, key=lambda x: (x[1], x[2], x[0])):
        if a >= reach:
            chain, reach = chain + 1, b
        reach = max(reach, b)
        yield chain, kind, a, b


def votes(kind: str, text: str, start: int, end: int, base: bool) -> str:
    """A character for each labeler: + for, - against, 0 if it has nothing to say."""
    span = text[start:end]
    before = re.findall(r"[\w-]+", text[max(0, start - 40) : start].lower())[-3:]
    low = span.lower()
    if kind == "email":
        parts = re.split(r"[@. ]+", low)
        known = parts[-1] in TOP_LEVEL or bool(PROVIDERS & set(parts))
        check = "+" if "@" in span and 5 <= len(span) <= 254 else "-"
    elif kind == "name":
        known = bool(GIVEN & set(low.split()))
        check = "+" if span[-1].islower() else "-"
    elif kind == "secret":
        known = low[:2] in ("sk", "pk") or low.startswith(("akia", "ghp", "xox")) or bool(_HEX.fullmatch(span))
        check = "+" if sum(c.isdigit() for c in span) >= 3 and any(c.isalpha() for c in span) else "-"
    else:
        d = _digits(span)
        known = False
        check = "+" if (kind == "card" and luhn(d)) or (kind == "phone" and 9 <= len(d) <= 13) or (kind == "ip" and not d.startswith("0")) else "-"
    cue = "+" if CUES[kind] & set(before) else "-" if AGAINST & set(before) else "0"
    sides = text[max(0, start - 1) : start] + text[end : end + 1]
    return ("+" if base else "-" if kind in BASE_RULES else "0") + ("+" if known else "0") + cue + check + ("-" if any(c.isalnum() for c in sides) else "+")


def shape(text: str, start: int, end: int) -> str:
    """A digit for each: length, share of digits, share of different characters, and whether the span is enclosed."""
    span = text[start:end]
    size, digits, varied = len(span), sum(c.isdigit() for c in span) / len(span), len(set(span)) / len(span)
    closed = text[max(0, start - 1) : start] in tuple("\"'([<{") and text[end : end + 1] in tuple("\"')]>}")
    return f"{(size > 8) + (size > 16) + (size > 31)}{(digits > 0.1) + (digits > 0.5)}{(varied > 0.3) + (varied > 0.6)}{int(closed)}"


def candidates(docs: DataFrame) -> DataFrame:
    """``doc_id, kind, start, end, base, chain, votes, shape`` for every candidate; ``docs`` has doc_id and text."""

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc_id, text in zip(frame.doc_id, frame.text, strict=True):
                own = base_spans(text)
                rows += [(doc_id, k, a, b, True, -1, votes(k, text, a, b, True), shape(text, a, b)) for k, a, b in own]
                rows += [(doc_id, k, a, b, False, n, votes(k, text, a, b, False), shape(text, a, b)) for n, k, a, b in chained(list(apart(more_spans(text), own)))]
            yield pd.DataFrame(rows, columns=["doc_id", "kind", "start", "end", "base", "chain", "votes", "shape"])

    return docs.mapInPandas(find, "doc_id long, kind string, start int, end int, base boolean, chain int, votes string, shape string")


def reliabilities(counts: list[tuple[str, str, int]], rounds: int = 50) -> dict[tuple[str, str], float]:
    """Expectation-maximisation for each kind over (kind, votes, count): labelers vote independently given
    the truth, each with its own chances of voting for and against; gives each pattern's probability."""
    out: dict[tuple[str, str], float] = {}
    for kind in {k for k, _, _ in counts}:
        rows = sorted((v, n) for k, v, n in counts if k == kind)
        v = np.array([["-0+".index(c) for c in p] for p, _ in rows])
        n = np.array([float(c) for _, c in rows])
        p = 1 / (1 + np.exp(-(v - 1).sum(1)))  # the majority, to begin with
        for _ in range(rounds):
            prior = (p @ n + 1) / (n.sum() + 2)
            chance = np.ones((2, len(rows)))
            for j in range(v.shape[1]):
                for side, w in enumerate((1 - p, p)):
                    table_ = np.array([((w * n)[v[:, j] == x]).sum() + (1 if x == 1 else 2 if (x == 2) == bool(side) else 0.5) for x in range(3)])
                    chance[side] *= (table_ / table_.sum())[v[:, j]]
            p = prior * chance[1] / (prior * chance[1] + (1 - prior) * chance[0])
        out |= {(kind, pattern): float(x) for (pattern, _), x in zip(rows, p, strict=True)}
    return out


def features(kind: str, pattern: str, form: str) -> np.ndarray:
    x = np.array(["-0+".index(c) - 1.0 for c in pattern])
    pairs = [x[i] * x[j] for i in range(len(x)) for j in range(i)]
    own = [float(form[i] == str(v)) for i, most in enumerate((4, 3, 3, 2)) for v in range(most)]
    return np.array([*x, *pairs, *own, *(float(kind == k) for k in KINDS)])


def classifier(counts: list[tuple[str, str, str, int]], steps: int = 400) -> dict[tuple[str, str, str], float]:
    """The final classifier's probability for every (kind, votes, shape) that was counted."""
    if not counts:
        return {}
    by_votes: dict[tuple[str, str], int] = {}
    for k, v, _, n in counts:
        by_votes[k, v] = by_votes.get((k, v), 0) + n
    soft = reliabilities([(k, v, n) for (k, v), n in by_votes.items()])
    x = np.array([features(k, v, f) for k, v, f, _ in counts])
    y = np.array([soft[k, v] for k, v, _, _ in counts])
    n = np.log1p(np.array([float(c) for *_, c in counts]))
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ w))
        w += 0.5 * (x.T @ (n * (y - p)) / n.sum() - 0.0005 * w)
    return {(k, v, f): float(p) for (k, v, f, _), p in zip(counts, 1 / (1 + np.exp(-x @ w)), strict=True)}


def detect(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, kind, start, end, base, probability``: every base span and the added ones.  Added ones overlap no base span, and of a chain of overlapping ones that
    are sure enough the surest stays (then the longest, then the first)."""
    found = written(candidates(documents(docs)), "candidates")
    counts = found.groupBy("kind", "votes", "shape").agg(F.count(F.lit(1)).alias("n")).collect()  # at most 6 x 3^5 x 108 rows
    known = classifier(sorted((r.kind, r.votes, r["shape"], r.n) for r in counts))
    model = docs.sparkSession.createDataFrame([(*k, p) for k, p in known.items()], "kind string, votes string, shape string, probability double")
    kept = found.join(F.broadcast(model), ["kind", "votes", "shape"]).where(F.col("base") | (F.col("probability") >= threshold))
    surest = Window.partitionBy("doc_id", "chain").orderBy(F.col("probability").desc(), (F.col("start") - F.col("end")), "start", "kind")
    added = kept.where("not base").withColumn("r", F.row_number().over(surest)).where("r = 1")
    return kept.where("base").unionByName(added.drop("r")).select("doc_id", "kind", "start", "end", "base", "probability")


def spans_by_document(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Counts of base spans and both span lists for every document; then counts of the other kinds, and of all spans."""
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    name = F.concat_ws(":", "kind", "start", "end")
    per = found.groupBy("doc_id").agg(
        *(F.count(F.when(F.col("base") & (F.col("kind") == k), 1)).alias(f"n_{k}") for k in KINDS[:4]),
        *(F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in KINDS[4:]),
        F.count(F.lit(1)).alias("n_spans"),
        F.array_sort(F.collect_list(F.when(F.col("base"), F.struct(rank.alias("r"), "start", name.alias("name"))))).alias("base"),
        F.array_sort(F.collect_list(F.struct(rank.alias("r"), "start", "end", name.alias("name")))).alias("every"),
    )
    ids = documents(docs).select("doc_id").join(per, "doc_id", "left")
    joined = lambda c: F.coalesce(F.array_join(F.col(f"{c}.name"), ","), F.lit(""))
    return ids.select(
        "doc_id", *(F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS[:4]), F.sha2(joined("base"), 256).alias("base_sha256"), joined("every").alias("spans"),
        *(F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in (*KINDS[4:], "spans")),
    )


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return spans_by_document(docs, detect(docs))
