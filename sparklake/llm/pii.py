"""Personal data by weak supervision.

Candidate spans come from the four base patterns, which stay whatever the method says, and from wider ones: access tokens
and other credentials, card and phone numbers inside of base matches that ran on and failed, local phone numbers,
spelt-out addresses, IBANs, social security numbers, names. Labelers vote on each candidate: its form, a checksum or
range, the words before and after it, gazetteers, and its digits' variety. The votes of all candidates of all documents
are counted by pattern, together with the span's length and shape, of which there are a bounded number;
expectation-maximisation over these counts estimates how reliable each labeler is for each kind without any label, and
a logistic classifier is trained on the labels that this gives. It decides, by votes, length and shape, which further
candidates are added; no candidate is dropped before it.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import bounded_batches, durable, free_name, pick, table, texts
from .learning import logistic, sigmoid

#: The kinds, in the order in which spans are listed; the first four are the base.
KINDS = ("email", "ip", "card", "phone", "email_spelt", "phone_local", "iban", "ssn", "name", "card_split", "phone_split", "credential")
BASE = 4
#: The kind whose labelers a kind shares: what makes a good card or phone number doesn't depend on where it was found.
FAMILY = np.array([KINDS.index({"email_spelt": "email", "phone_local": "phone", "card_split": "card", "phone_split": "phone"}.get(k, k)) for k in KINDS])

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9]){15,}")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
SPELT = re.compile(r"(?: ?[\[(]at[\])] ?)([A-Za-z0-9-]+(?: ?[\[(]dot[\])] ?[A-Za-z0-9-]+)+)")
PHONE_LOCAL = re.compile(r"(?<![0-9+(.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
DIGIT = re.compile(r"[0-9]")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
PHONE_SPLIT = re.compile(r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])")
CARD_SPLIT = re.compile(r"(?<![0-9])[0-9]{13,19}(?![0-9])|(?<![0-9])[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])")
TOKEN, TOKEN_LEAST = re.compile(r"[A-Za-z0-9_-]+"), 16
TOKEN_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-")
NAME = re.compile(r"[A-ZÀ-Þ][a-zß-ÿ]+ [A-ZÀ-Þ][a-zß-ÿ]+")

# Words that speak for or against a kind, and gazetteers of common first names and address endings.
FOR = {
    "email": "mail email e-mail contact write reach address correo courriel", "email_spelt": "mail email e-mail contact write reach address", "ip": "ip host server address client login from addr", "card": "card visa mastercard amex credit debit carte karte tarjeta payment",
    "phone": "phone tel telephone call mobile cell fax whatsapp telefon teléfono téléphone", "phone_local": "phone tel telephone call mobile cell fax whatsapp telefon teléfono téléphone", "iban": "iban account bank konto compte cuenta", "ssn": "ssn social security insurance", "name": "mr mrs ms dr name named called herr frau madame monsieur señor señora dear",
    "credential": "token secret password passwd pwd key apikey api auth credential bearer access",
}
FOR |= {"card_split": FOR["card"], "phone_split": FOR["phone"]}
AGAINST = frozenset("version release build order item ref reference isbn doi section chapter id serial model part figure table hash commit invoice sha sha1 sha256 md5 checksum digest etag revision uuid guid".split())
NAMES = frozenset("james mary john patricia robert jennifer michael linda david elizabeth william barbara richard susan joseph jessica thomas sarah charles karen anna maria jose juan carlos luis pierre jean marie claude hans klaus peter petra sabine jürgen monika camille antoine sofia lucia pablo emma olivia noah liam lucas paul laura julia daniel mark george helen alice".split())
ENDINGS = frozenset("com org net edu gov mil int info biz io co uk de fr es it nl be ch at us ca au in jp cn br ru eu dev app".split())
LABELERS = ("form", "check", "before", "against", "gazetteer", "variety")
CHECK, SUMMED = LABELERS.index("check"), np.isin(KINDS, ["card", "iban"])
NEAR = re.compile(r"[^\W\d_]+")
ASSIGNED, LONG_WORD = re.compile(r"[=:][ \t]*[\"'`]?$|[\"'`]$"), re.compile(r"[a-z]{8}|[A-Z]{8}|[0-9]{14}")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c)
        if k & 1:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns' matches that pass, by kind and then by start."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:  # the local part is the run before the @, as far as the last match leaves it
        a = at
        while a > free and text[a - 1] in LOCAL:
            a -= 1
        m = DOMAIN.match(text, at + 1) if a < at else None
        if m:
            out.append(("email", a, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    for m in IP.finditer(text):
        if all(len(p) < 20 and int(p) <= 255 or not p.strip("0") or len(p.lstrip("0")) <= 3 and int(p.lstrip("0")) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        d = _digits(m[0])
        if len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= len(_digits(m[0])) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def wider_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    for m in CARD.finditer(text):  # what the base pattern takes for more digits than it is, or for other ones
        if len(d := _digits(m[0])) > 19 or not luhn(d):
            out += [("card_split", x.start(), x.end()) for x in CARD_SPLIT.finditer(text, m.start(), m.end())]
    if "+" in text:
        for m in PHONE.finditer(text):
            if not 8 <= len(_digits(m[0])) <= 15:
                out += [("phone_split", x.start(), x.end()) for x in PHONE_SPLIT.finditer(text, m.start(), m.end())]
    at = DIGIT.search(text)
    while at:  # a token holds a digit, and digits are rare: from each, back to where its token begins
        a = at.start()
        while a > 0 and text[a - 1] in TOKEN_CHARS:
            a -= 1
        b = TOKEN.match(text, a).end()
        if b - a >= TOKEN_LEAST and not text[a:b].replace("-", "").isdigit():
            out.append(("credential", a, b))
        at = DIGIT.search(text, b)
    if "at)" in text or "at]" in text:
        for m in SPELT.finditer(text):
            a = m.start()
            while a > 0 and text[a - 1] in LOCAL:
                a -= 1
            if a < m.start():
                out.append(("email_spelt", a, m.end()))
    for kind, p in (("phone_local", PHONE_LOCAL), ("iban", IBAN), ("ssn", SSN), ("name", NAME)):
        out += [(kind, m.start(), m.end()) for m in p.finditer(text)]
    return out


def votes(text: str, kind: str, start: int, end: int) -> tuple[int, ...]:
    """Each labeler's vote on a candidate: 1 for, -1 against, 0 abstains."""
    s, d = text[start:end], _digits(text[start:end])
    before = [w.lower() for w in NEAR.findall(text[max(0, start - 40) : start])[-3:]]
    after = [w.lower() for w in NEAR.findall(text[end : end + 20])[:1]]
    ending = s.rsplit(".", 1)[-1].lower() if kind == "email" else NEAR.findall(s)[-1].lower() if kind == "email_spelt" and NEAR.findall(s) else ""
    form = True  # True for, None abstains, False against
    if kind == "email":
        form = s[0].isalnum() and ".." not in s or None
    elif kind == "ip":
        form = all(p == "0" or p[0] != "0" for p in s.split(".")) or None
    elif kind in ("card", "card_split"):
        form = d[0] in "23456" and (" " not in s or len(s.split()) in (4, 5)) or (None if kind == "card" else False)
    elif kind == "phone":
        form = d[0] != "0" and len(d) >= 10 or None
    elif kind == "iban":
        form = len(s.replace(" ", "")) >= 15 or None
    elif kind == "name":
        form = None
    elif kind == "credential":
        form = bool(ASSIGNED.search(text, max(0, start - 8), start))
    check = 0
    if kind == "credential":  # random characters change their kind often and leave no long word
        check = -1 if len(set(s)) < 8 or LONG_WORD.search(s) else 1
    elif kind in ("card", "card_split"):
        check = 1 if luhn(d) else -1
    elif kind == "iban":
        turned = s.replace(" ", "")[4:] + s[:4]
        check = 1 if int("".join(str(int(c, 36)) for c in turned)) % 97 == 1 else -1
    elif kind == "ssn":
        check = -1 if d[:3] in ("000", "666") or d[0] == "9" or d[3:5] == "00" or d[5:] == "0000" else 1
    elif kind == "ip":
        check = -1 if d[0] == "0" or s.split(".")[0] in ("127", "255") else 1
    elif kind == "phone_local":
        check = -1 if d[0] in "01" or d[3] in "01" else 1
    gazetteer = (1 if ending in ENDINGS else -1) if ending else (1 if s.split()[0].lower() in NAMES else -1) if kind == "name" else 0
    known = FOR[kind].split()
    variety = 0 if not d or kind in ("email", "email_spelt", "credential") else -1 if len(set(d)) <= 2 else 0
    return (0 if form is None else 1 if form else -1, check, 1 if any(w in known for w in before) else 0, -1 if any(w in AGAINST for w in before + after) else 0, gazetteer, variety)


def shape(span: str) -> int:
    """What a span is made of, 0 to 26: the thirds that digits, capitals and signs or spaces make of it."""
    n = len(span)
    third = lambda k: min(2, 3 * k // n)
    digits, capitals, plain = sum(map(str.isdigit, span)), sum(map(str.isupper, span)), sum(map(str.isalnum, span))
    return 9 * third(digits) + 3 * third(capitals) + third(n - plain)


FOUND = "id long, spans array<struct<kind:int,start:long,end:long,base:boolean,votes:string,length:int,shape:int>>"


def _find(batches):
    span = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("votes", pa.string()), ("length", pa.int32()), ("shape", pa.int32())])
    for batch in batches:
        rows = []
        for text in texts(batch.column(1)).to_pylist():
            own = base_spans(text)
            taken = sorted((a, b) for _, a, b in own)
            found = []
            for k, a, b in own + [x for x in wider_spans(text) if not _overlaps(taken, x[1], x[2])]:
                v = ",".join(map(str, votes(text, k, a, b)))
                found.append({"kind": KINDS.index(k), "start": a, "end": b, "base": KINDS.index(k) < BASE, "votes": v, "length": min(7, (b - a) // 5), "shape": shape(text[a:b])})
            rows.append(found)
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(rows, pa.list_(span))], names=["id", "spans"])


def _overlaps(taken: list[tuple[int, int]], a: int, b: int) -> bool:
    from bisect import bisect_left

    k = bisect_left(taken, (b, 0))
    return any(taken[i][1] > a for i in range(max(0, k - 2), k))


def expectation_maximisation(kind: np.ndarray, vote: np.ndarray, count: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """(probability of being personal data for each pattern, reliability[kind, labeler] of each labeler when it votes).

    Naive Bayes over the labelers on patterns with their counts: a prior for each kind, a table of votes for each family
    of kinds. Starts from the majority, and a prior of ten votes holds that a labeler is right in four of five cases, one
    of twenty that a checksum is in nineteen of twenty: they settle families with few candidates.
    """
    p, family = sigmoid(1.5 * vote.sum(1)), FAMILY[kind]
    kinds, n_votes = len(KINDS), vote.shape[1]
    tables = np.zeros((kinds, 2, n_votes, 2))
    for _ in range(rounds):
        weight = np.stack([count * (1 - p), count * p])
        totals = np.stack([np.bincount(kind, w, kinds) for w in weight])
        prior = (totals[1] + 1) / (totals.sum(0) + 2)
        for j in range(n_votes):
            right, wrong = (np.where(SUMMED, 19, 8), np.where(SUMMED, 1, 2)) if j == CHECK else (8, 2)
            for y in (0, 1):
                for v in (0, 1):  # against, for
                    tables[:, y, j, v] = np.bincount(family, weight[y] * (vote[:, j] == 2 * v - 1), kinds) + (right if v == y else wrong)
        share = tables / tables.sum(-1, keepdims=True)
        score = np.log(prior[kind] / (1 - prior[kind]))
        for j in range(n_votes):  # who abstains says nothing
            v = (vote[:, j] > 0).astype(int)
            score = score + (vote[:, j] != 0) * np.log(share[family, 1, j, v] / share[family, 0, j, v])
        now = sigmoid(score)
        if np.abs(now - p).max() < 1e-9:
            break
        p = now
    share = share[FAMILY]
    return p, prior[:, None] * share[:, 1, :, 1] + (1 - prior[:, None]) * share[:, 0, :, 0]


def features(kind: np.ndarray, vote: np.ndarray, length: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    return np.concatenate([kind[:, None] == np.arange(len(KINDS)), vote > 0, vote < 0, length[:, None] == np.arange(8), shapes[:, None] // np.array([9, 3, 1]) % 3 == 1, shapes[:, None] // np.array([9, 3, 1]) % 3 == 2], 1).astype(float)


def train(patterns: list[tuple[int, str, int, int, int]]) -> np.ndarray:
    """The span classifier's weights, from (kind, votes, length, shape, count) of all candidates."""
    if not patterns:
        return np.zeros(len(KINDS) + 2 * len(LABELERS) + 15)
    kind, length, shapes = (np.array([x[i] for x in patterns]) for i in (0, 2, 3))
    vote, count = np.array([[int(v) for v in x[1].split(",")] for x in patterns]), np.array([x[4] for x in patterns], float)
    p, _ = expectation_maximisation(kind, vote, count)
    return logistic(features(kind, vote, length, shapes), p, count, 0.1)


CHOSEN = "id long, spans array<struct<kind:string,start:long,end:long,base:boolean>>"


def _choose(weights: np.ndarray):
    def run(batches):
        span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])
        for batch in batches:
            rows = batch.column(1).to_pylist()
            more = [(i, s) for i, r in enumerate(rows) for s in r if not s["base"]]
            out = [[(s["kind"], s["start"], s["end"], True) for s in r if s["base"]] for r in rows]
            if more:
                x = features(np.array([s["kind"] for _, s in more]), np.array([[int(v) for v in s["votes"].split(",")] for _, s in more]), np.array([s["length"] for _, s in more]), np.array([s["shape"] for _, s in more]))
                p = sigmoid(np.c_[x, np.ones(len(x))] @ weights)
                added: dict[int, list[tuple[int, int]]] = {}
                for (i, s), q in sorted(zip(more, p, strict=True), key=lambda z: (z[0][0], z[0][1]["start"] - z[0][1]["end"], -z[1], z[0][1]["kind"], z[0][1]["start"])):
                    taken = added.setdefault(i, [])
                    if q >= 0.5 and not any(a < s["end"] and s["start"] < b for a, b in taken):
                        taken.append((s["start"], s["end"]))
                        out[i].append((s["kind"], s["start"], s["end"], False))
            done = [[{"kind": KINDS[k], "start": a, "end": b, "base": base} for k, a, b, base in sorted(r)] for r in out]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(done, pa.list_(span))], names=["id", "spans"])

    return run


def learn(found: DataFrame) -> np.ndarray:
    """train() on the candidates of all rows, counted by pattern: a few thousand counts at most, whatever the input."""
    each = found.select(F.explode("spans").alias("s"))
    return train([tuple(r) for r in each.groupBy("s.kind", "s.votes", "s.length", "s.shape").agg(F.count("*").alias("many")).orderBy("kind", "votes", "length", "shape").collect()])


def find_personal_data(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) of every row: the kind, start and end (code points, end exclusive) of each span, and whether a base
    pattern found it; by kind in the order of KINDS, then by start.

    Null and empty texts have no spans. Added spans overlap neither base spans nor each other. Equal texts get equal
    spans; repeated rows repeated results; an empty table no rows. Other columns are not looked at.
    """
    bounded_batches(documents.sparkSession)
    found = durable(pick(documents, id_col, text_col).mapInArrow(_find, FOUND))
    return found.mapInArrow(_choose(learn(found)), CHOSEN)


def _masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """text with each span, or run of overlapping spans, replaced by the kind of its first one."""
    out, at, end, kind = [], 0, 0, ""
    for a, b, k in [*spans, (len(text) + 1, 0, "")]:
        if a >= end:
            if kind:
                out.append(f"<{kind}>")
                at = end
            out.append(text[at:a])
            kind, end = k, b
        else:
            end = max(end, b)
    return "".join(out)


def masked(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """documents with every span of text_col replaced by its kind in angle brackets, as find_personal_data would find it.

    Null texts stay null, empty ones empty; repeated rows stay repeated; an empty table gives an empty one; other columns
    may have any names. Texts are scanned once: rows and candidates wait in the shared folder until all candidates have
    been counted."""
    spark, names = documents.sparkSession, documents.columns
    bounded_batches(spark)
    spans, at = free_name(documents, "_spans"), names.index(text_col)
    kind = StructType.fromDDL(FOUND)["spans"].dataType

    def find(batches):
        for batch in batches:
            one = pa.RecordBatch.from_arrays([pa.nulls(len(batch), pa.int64()), batch.column(at)], names=["id", "text"])
            yield pa.RecordBatch.from_arrays([*batch.columns, next(_find([one])).column(1)], names=[*names, spans])

    written = durable(documents.mapInArrow(find, StructType([*documents.schema.fields, StructField(spans, kind)])))
    choose = _choose(learn(written.select(F.col(f"`{spans}`").alias("spans"))))

    def run(batches):
        for batch in batches:
            column, own = batch.column(at), batch.column(len(names))
            chosen = next(choose([pa.RecordBatch.from_arrays([pa.nulls(len(batch), pa.int64()), own], names=["id", "spans"])])).column(1).to_pylist()
            out = [_masked(t, sorted((s["start"], s["end"], s["kind"]) for s in found)) if found else t for t, found in zip(column.to_pylist(), chosen, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(out, column.type) if i == at else c for i, c in enumerate(batch.columns[: len(names)])], names=names)

    return written.mapInArrow(run, documents.schema)


def op9_pii(spark, sf_dir):
    found = find_personal_data(table(spark, sf_dir, "documents"))
    of = lambda k: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == k))).cast("long").alias(f"n_{k}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(F.col("id").alias("doc_id"), *(of(k) for k in KINDS[:BASE]), F.sha2(joined(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
