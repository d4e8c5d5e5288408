"""Secret scans: a wide net of candidates, and a random forest that takes the false positives out of it.

Candidates are tokens that look random or stand where credentials stand. Each becomes a row of numbers: its length, how its
characters follow one another, how much of it a dictionary covers, where it was found and which words are beside it. A
random forest trained on labelled findings scores the rows. Without findings of one's own, findings() makes labelled ones
from the formats of real credentials and of the things that are mistaken for them.
"""

from __future__ import annotations

import re
import string
from bisect import bisect_left
from collections import Counter
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, table, texts
from .learning import forest, vote

#: A candidate: 12 characters or more of the alphabets of credentials, with a digit or of mixed case, or the whole value,
#: of LEAST characters or more of any alphabet, that is quoted or assigned behind the name of a secret. Longer ones are
#: taken whole.
TOKEN = re.compile(r"[A-Za-z0-9_+/=.~-]{12,}")
LEAST = 4
# Names of secrets, and words that are part of such names where a word begins; what may stand between name and value. The
# set of first letters is what the search skips along.
_NAME = r"[AaCcKkPpSsTt](?:((?<=[Pp])(?i:assword|asswd|assphrase|asscode|wd)|(?<=[Ss])(?i:ecret)|(?<=[Tt])(?i:oken)|(?<=[Cc])(?i:redential)|(?<=[Aa])(?i:pi[_-]?key))|(?:(?<![A-Za-z].)|(?<=[a-z][A-Z]))(?:(?<=[Kk])(?i:ey)|(?<=[Pp])(?i:ass|in)|(?<=[Aa])(?i:uth)))[A-Za-z0-9_-]{0,40}"
_BETWEEN = r"(?:[\\\"'`\]]{0,3}[ \t]*+(?::[ \t]*+[A-Za-z_][\w.\[\]|]*+[ \t]++(?==))?(?::=|=>|={1,3}|:)[ \t]*+(?:(?i:bearer|basic|token)[ \t]++)?|[ \t]*+[ \t(][ \t]*+(?=[\"'`]))"
NAMED = re.compile(_NAME + _BETWEEN)
NAMED_BEFORE = re.compile(_NAME + _BETWEEN.replace("(?=[\"'`])", "(?=[\"'`]$)") + r"(?:[rbfuRBFU]{0,2}\\?[\"'`])?$")
QUOTED = re.compile(r"[rbfuRBFU]{0,2}(?:\"((?:[^\"\\\n]|\\.)*+)\"|'((?:[^'\\\n]|\\.)*+)'|`((?:[^`\\\n]|\\.)*+)`|\\\"([^\"\\\n]*+)\\\")")
BARE = re.compile(r"[\"'`]?((?:(?![,;&][A-Za-z_][\w.-]*+[ \t]*+[=:])[^\s\"'`])++)")
QUERY = re.compile(r"([^\s\"'`&#]++)")
STAND_IN = re.compile(r"(?i)[<$%{(\[].*|(.)\1*|.*[(\[].*[)\]].*|.*(?:change_?me|example|placeholder|your|here|environ|getenv).*|(?:none|null|nil|true|false|yes|undefined|str|string|bytes|int|self\..*|config\..*)", re.S)
KEY_BLOCK = re.compile(r"-----BEGIN ([A-Z ]*)PRIVATE KEY-----[A-Za-z0-9+/=\s]*+(?:-----END \1PRIVATE KEY-----)?")
WORD = re.compile(r"[A-Za-z]{2,}")

# Prefixes of well-known credentials, words beside secrets and beside other random strings, places where
# either is usual, and syllables that words are made of.
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "sk_live_", "rk_live_", "AIza", "ya29.", "eyJ", "SG.", "npm_", "pypi-", "hf_")
SECRET_WORDS = frozenset("token secret password passwd pwd key apikey api auth credential credentials bearer private access authorization client login".split())
OTHER_WORDS = frozenset("sha sha1 sha256 md5 hash checksum digest commit revision uuid guid id etag version integrity build trace request session example sample test dummy placeholder changeme file path url".split())
SECRET_PLACES = ("env", "config", "settings", "secret", "credential", ".pem", ".key", "deploy", "docker")
OTHER_PLACES = ("test", "example", "sample", "mock", "fixture", "lock", "doc", "readme", "changelog", ".md")
SYLLABLES = frozenset("an ar as at be co com con de di ed en er es ex for ge he hi ic ide in ing ion is it ity le li lo ly ma me men ment mo na ne no of on or ou per ple pre pro ra re ri ro se si st sta sub ta te ted ter th the ti tion to tra tri un ure use ve ver vi wh".split())
CLASSES = {c: k for k, chars in enumerate((string.ascii_lowercase, string.ascii_uppercase, string.digits)) for c in chars}
FEATURES = ("length", "entropy", "hex", "digits", "upper", "punctuation", "transitions", "kinds", "repeats", "longest_word", "covered", "prefix", "quoted", "assigned", "secret_words", "other_words", "secret_place", "other_place", "in_path", "uuid", "vowels", "padded", "named", "stand_in")


def values(text: str) -> set[tuple[int, int]]:
    """(start, end) of the whole values that are quoted or assigned behind the name of a secret.

    In a bare value that assigns on, as a=b=c, each name has what stands up to the next one besides."""
    out, bare, until = set(), [], -1

    def add(a: int, b: int, trim: bool) -> None:
        opened = {c: text.count(o, a, b) - text.count(c, a, b) for o, c in ("()", "[]", "{}", "<>")} if trim else {}
        while trim and a < b and (text[b - 1] in ".,;" or opened.get(text[b - 1], 0) < 0):
            b -= 1
            if text[b] in opened:
                opened[text[b]] += 1
        if b - a >= LEAST and not text[a:b].isspace():
            out.add((a, b))

    for m in NAMED.finditer(text):
        at = m.end()
        if v := QUOTED.match(text, at):
            add(*v.span(v.lastindex), False)
        elif at < until:
            bare.append((m.start(), at, until))
        elif v := (QUERY if text[max(0, m.start() - 1) : m.start()] in ("?", "&") else BARE).match(text, at):
            until = v.end(1)
            bare.append((m.start(), v.start(1), until))
            add(v.start(1), until, True)
    for (_, a, b), (start, _, _) in zip(bare, bare[1:] + [(len(text), 0, 0)], strict=False):
        add(a, min(b, start), True)
    return out


def candidates(text: str) -> list[tuple[int, int]]:
    """(start, end) of the candidates. Of two that overlap, one holds the other: a value and a token or value in it."""
    blocks = [m.span() for m in KEY_BLOCK.finditer(text)] if "PRIVATE KEY-----" in text else []
    out, k = list(blocks), 0
    for m in TOKEN.finditer(text):
        a, b = m.span()
        while a < b and text[b - 1] in ".-=_" and (text[b - 1] != "=" or b - a > 64):
            b -= 1
        while a < b and text[a] in "=.-/~":
            a += 1
        if "=" in text[a:b].rstrip("="):  # name=value: the value
            a = a + text[a:b].rstrip("=").rindex("=") + 1
        s = text[a:b]
        if len(s) < 12:
            continue
        while k < len(blocks) and blocks[k][1] <= a:
            k += 1
        if k < len(blocks) and a < blocks[k][1] and blocks[k][0] < b:
            continue
        if any(c.isdigit() for c in s) or not (s.islower() or s.isupper() or s.istitle()):
            out.append((a, b))
    for a, b in values(text):
        k = bisect_left(blocks, (b, 0))  # blocks[k - 1] is the last that begins before b
        if not k or blocks[k - 1][1] <= a:
            out.append((a, b))
    return sorted(set(out))


def outermost(found: list[tuple]) -> list[tuple]:
    """Of rows (id, start, end, ...) of one text, by start: those that are in no other."""
    out, end = [], -1
    for r in sorted(found, key=lambda r: (r[1], -r[2])):
        if r[2] > end:
            out.append(r)
            end = r[2]
    return out


def features(text: str, start: int, end: int, place: str) -> list[float]:
    """The numbers of FEATURES for the candidate text[start:end], found at place."""
    s = text[start:end]
    n, counts = len(s), Counter(s)
    share = np.array(list(counts.values())) / n
    kinds = [CLASSES.get(c, 3) for c in s]
    turns = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False))
    words, low = WORD.findall(s), s.lower()
    covered = np.zeros(n, bool)
    for k in (2, 3, 4):
        for i in range(n - k + 1):
            if low[i : i + k] in SYLLABLES:
                covered[i : i + k] = True
    before, after = text[max(0, start - 40) : start], text[end : end + 20]
    near = [w.lower() for w in re.findall(r"[A-Za-z0-9]+", before)[-4:] + re.findall(r"[A-Za-z0-9]+", after)[:2]]
    near += [w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+", " ".join(re.findall(r"[A-Za-z0-9_]+", before)[-2:]))]
    where, named = place.lower(), NAMED_BEFORE.search(before)
    return [
        min(n, 200), float(-(share * np.log2(share)).sum()), float(all(c in "0123456789abcdefABCDEF" for c in s)), kinds.count(2) / n, kinds.count(1) / n, kinds.count(3) / n,
        turns / max(1, n - 1), len(set(kinds)), max(counts.values()) / n, max(map(len, words), default=0), float(covered.mean()), float(s.startswith(PREFIXES) or s.startswith("-----BEGIN")),
        float(before[-1:] in "\"'`" and before != ""), float(bool(re.search(r"[=:]\s*[\"'`]?$", before))), sum(w in SECRET_WORDS for w in near), sum(w in OTHER_WORDS for w in near),
        sum(p in where for p in SECRET_PLACES), sum(p in where for p in OTHER_PLACES), float("/" in s or before[-1:] == "/"),
        float(bool(re.fullmatch(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", s))), sum(c in "aeiou" for c in low) / n, float(s.endswith("=")),
        0.0 if named is None else 2.0 if named[1] else 1.0, float(bool(STAND_IN.fullmatch(s[:200]))),
    ]


def findings(n: int = 6000, seed: int = 11) -> list[tuple[str, int, int, str, int]]:
    """(text, start, end, place, label) of n made-up findings, half of them secrets."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    chars = lambda alphabet, k: "".join(alphabet[i] for i in rng.integers(0, len(alphabet), k))
    hexa, b62, b64 = "0123456789abcdef", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"
    syllables = sorted(SYLLABLES)
    word = lambda: "".join(syllables[i] for i in rng.integers(0, len(syllables), int(rng.integers(2, 5))))
    prose = lambda: " ".join(word() for _ in range(int(rng.integers(2, 7))))
    secret = (
        lambda: chars(hexa, pick((32, 40, 64))), lambda: chars(b62, int(rng.integers(20, 48))), lambda: chars(b64, pick((40, 43, 64))) + pick(("", "=", "==")), lambda: "AKIA" + chars(string.ascii_uppercase + string.digits, 16), lambda: pick(("ghp_", "gho_", "ghs_")) + chars(b62, 36),
        lambda: "xoxb-" + chars(string.digits, 12) + "-" + chars(b62, 24), lambda: pick(("sk_live_", "rk_live_")) + chars(b62, 24), lambda: "eyJ" + chars(b62, 20) + "." + chars(b62, 40) + "." + chars(b62, 30), lambda: chars(b62 + "-_", int(rng.integers(16, 40))),
    )
    other = (
        lambda: chars(hexa, pick((32, 40, 64))), lambda: "-".join(chars(hexa, k) for k in (8, 4, 4, 4, 12)), lambda: "/".join(word() for _ in range(int(rng.integers(3, 6)))) + pick((".py", ".txt", "", ".v2")), lambda: "_".join(word() for _ in range(3)) + str(int(rng.integers(100))),
        lambda: word().title() + word().title() + word().title(), lambda: chars(string.digits, int(rng.integers(12, 20))), lambda: "-".join((str(2000 + int(rng.integers(30))), chars("01", 2), chars("012", 2))) + "T" + chars("012", 2) + "-00", lambda: pick(("x" * 20, "0" * 16, "your_token_here", "CHANGE_ME_PLEASE1", "1234567890abcdef", "abcdefghijklmnop1")),
        lambda: word() + "." + word() + "." + word() + "2", lambda: word() + "%d@mail" % int(rng.integers(99)) + "." + word(), lambda: word() + word() + word() + str(int(rng.integers(9))),
    )
    # passwords, which only their place gives away, and what stands in such places without being one
    signs = string.punctuation.translate({ord(c): None for c in "\"'`\\"})
    password = (
        lambda: word() + chars(string.digits, int(rng.integers(1, 5))) + chars("!@#$%&*?", int(rng.integers(0, 3))), lambda: word() + word() + word() + word(), lambda: chars(string.ascii_lowercase, int(rng.integers(8, 17))), lambda: chars(b62 + signs, int(rng.integers(6, 21))),
        lambda: pick("!@#$%.:").join(chars(b62, int(rng.integers(2, 6))) for _ in range(3)), lambda: word().title() + pick("!@#$-_") + chars(string.digits, 4), lambda: pick(" -").join(word() for _ in range(4)), lambda: chars(string.digits, int(rng.integers(4, 10))), lambda: word(),
    )
    stand_in = (
        lambda: "${%s}" % word().upper(), lambda: "<%s>" % word(), lambda: pick(("None", "null", "true", "false", "undefined", "string", "str")), lambda: pick("*x.0") * int(rng.integers(4, 13)), lambda: pick(("changeme", "CHANGE_ME", "your_password_here", "your-token-here", "example", "placeholder")),
        lambda: word() + "_" + word() + "()", lambda: "os.environ[%s]" % word().upper(), lambda: "config." + word(), lambda: "{{ %s }}" % word(),
    )
    out = []
    for k in range(n):
        label = k % 2
        if rng.random() < 0.3:
            s, q = pick(password if label else stand_in)(), pick(('"', "'", '"', "'", ""))
            name = pick(("password", "passwd", "db_password", "PASSWORD", "pwd", "secret", "client_secret", "token", "passphrase", "api_key"))
            if not label and rng.random() < 0.4:  # words behind a word that is no secret's name, or in prose
                s, name, q = (word(), "key", q) if rng.random() < 0.5 else (word(), name, "")
            if label and not q and (" " in s or s.islower() and len(s) < 14):  # bare words say nothing
                q = '"'
            between, opening = (pick(('": ', '" : ')), '"') if q == '"' and rng.random() < 0.3 else (pick((" = ", "=", ": ")), "")
            before, after = f"{prose()} {opening}{name}{between}{q}", f"{q} {prose()}"
            out.append((before + s + after, len(before), len(before) + len(s), pick(("", "src0", "config/settings.py", "app/main.py")), label))
            continue
        s = pick(secret if label else other)()
        names = ("token", "api_key", "secret", "password", "auth_token", "client_secret", "access_key", "SECRET_KEY") if label else ("sha256", "commit", "id", "uuid", "checksum", "path", "etag", "md5", "name", "build")
        plain = rng.random() < (0.1 if label else 0.6)
        if plain:
            before, after = prose() + " ", " " + prose()
        else:
            q = pick(('"', "'", ""))
            before, after = f"{prose()} {pick(names)}{pick((' = ', '=', ': '))}{q}", f"{q} {prose()}"
        if label and plain and s == "".join(c for c in s if c in hexa):  # a bare hexadecimal string says nothing
            before = f"{prose()} {pick(('token', 'Bearer', 'key'))} "
        places = ("", "src0", "config/settings.py", "deploy/.env", "app/main.py") if label else ("", "src0", "tests/test_app.py", "package-lock.json", "docs/readme.md", "app/main.py")
        out.append((before + s + after, len(before), len(before) + len(s), pick(places), label))
    return out


def train(found: list[tuple[str, int, int, str, int]]) -> list:
    """The forest for labelled findings (text, start, end, place, label); null texts teach nothing, none give no trees."""
    rows = [(features(t, a, b, p or ""), y) for t, a, b, p, y in found if t is not None and b > a]
    return forest(np.array([x for x, _ in rows]), np.array([y for _, y in rows])) if rows else []


SCHEMA = "id long, start long, end long, secret string, score double"


def _scan(shared, threshold: float):
    def run(batches):
        trees = shared.value
        for batch in batches:
            out, x = [], []
            for row, (key, place, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch.column(2)).to_pylist(), strict=True)):
                for a, b in candidates(text):
                    out.append((key, a, b, text[a:b], row))
                    x.append(features(text, a, b, place or ""))
            if out:
                score = vote(trees, np.array(x))
                kept = [(*r, float(p)) for r, p in zip(out, score, strict=True) if p >= threshold]
                # of a value and what is in it, the value
                kept = [r[:4] + r[5:] for _, same in groupby(kept, itemgetter(4)) for r in outermost(list(same))]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64()]
                columns = list(zip(*kept, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["id", "start", "end", "secret", "score"])

    return run


def scan_secrets(documents: DataFrame, trees: list, id_col: str = "doc_id", text_col: str = "text", place_col: str | None = "source", threshold: float = 0.5) -> DataFrame:
    """(id, start, end, secret, score): a row for each candidate of each whole text that the forest scores at least threshold
    and that is in no other such.

    start and end are code points, end exclusive. place_col is where a text is from (a path, a source); null or none
    says nothing. Null and empty texts have no candidates; repeated rows give repeated rows; an empty table none. Without
    trees every score is 0. Other columns are not looked at.
    """
    spark = documents.sparkSession
    bounded_batches(spark)
    place = F.col(f"`{place_col}`").cast("string") if place_col else F.lit("")
    cols = [F.col(f"`{id_col}`").cast("long").alias("id"), place.alias("place"), F.col(f"`{text_col}`").cast("string").alias("text")]
    return documents.select(cols).mapInArrow(_scan(spark.sparkContext.broadcast(trees), threshold), SCHEMA)


def op10_secret_scan(spark, sf_dir):
    """The found secrets, as digests: what the scan is for is not to be copied around."""
    found = scan_secrets(table(spark, sf_dir, "documents"), train(findings()))
    return found.select(F.col("id").alias("doc_id"), "start", "end", F.sha2("secret", 256).alias("secret_sha256"), F.round("score", 6).alias("score"))
