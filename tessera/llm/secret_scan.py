"""Secret scans: candidates by pattern, false positives removed by a random forest.

Candidates are key-like strings found by a few patterns (vendor keys, private-key headers, JSON web tokens,
dotted keys, bearer and basic credentials, passwords in addresses, assignments to words such as password or token, long
random-looking runs). Each gets features: length, character
classes and transitions, entropy, likelihood of its letter pairs, how much of it dictionary words cover, whether it
looks like a path, a UUID, a placeholder or a repeated pattern, and which words stand next to it. A random forest
trained from labelled findings tells secrets from the rest. The findings and the forest are bounded by parameters
(``max_findings`` rows, ``trees`` x 2^``depth`` nodes), so the model is sent with the tasks.

``labelled_findings`` gives findings of known label made from a seed: keys drawn at random in their formats, passwords as
people make them (joined or doubled words, words with digits and signs), and hashes, ids, paths, host names, placeholders,
code and plain words that only look like keys. Findings of one's own can be given instead.

One pass over the documents without a shuffle. Edge cases: null or empty text has no candidates; repeated rows are
scanned on their own; overlapping candidates: the first pattern in order, then the leftmost, wins; other columns stay
in ``redact`` and are dropped by the query.
"""

from __future__ import annotations

import math
import re
import string
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, worker_cache

#: In a private key: white space, plain or escaped; header lines; lines of base64, of which the last may be short.
_BLANK = r"(?:\s|\\+[nrt])"
_HEADERS = rf"(?:{_BLANK}*+[A-Za-z][A-Za-z0-9-]*+:[^\r\n\\]*+(?=[\r\n\\]))*+"
_BODY = rf"(?:{_BLANK}*+[A-Za-z0-9+/]{{24,}}+={{0,2}})++(?:{_BLANK}++[A-Za-z0-9+/]++={{0,2}}(?=[ \t]*+(?:[\r\n\\\"']|\Z)))?"
#: Candidates run to their natural end: classes without a limit are possessive, so that a scan stays linear.
PATTERNS = (
    ("private_key", re.compile(rf"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----(?:{_HEADERS}(?:[A-Za-z0-9+/=\s\\\"',>#|]*+-----END (?:[A-Z]+ )?PRIVATE KEY-----|{_BODY}))?")),
    ("aws_key_id", re.compile(r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b")),
    ("github_token", re.compile(r"\bgh[pousr]_[A-Za-z0-9]{36,}+\b")),
    ("github_token", re.compile(r"\bgithub_pat_[A-Za-z0-9_]{20,}+")),
    ("slack_token", re.compile(r"\bxox[abprs]-[A-Za-z0-9-]{10,}+")),
    ("api_key", re.compile(r"\b(?:sk|pk|rk)[-_](?:live[-_]|test[-_]|proj[-_])?[A-Za-z0-9]{16,}+\b")),
    ("google_key", re.compile(r"\bAIza[0-9A-Za-z_-]{35,}+")),
    ("jwt", re.compile(r"\beyJ[A-Za-z0-9_-]{8,}+(?:\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)?")),
    ("dotted_key", re.compile(r"(?<![\w./-])[A-Za-z0-9_-]{2,}+\.[A-Za-z0-9_-]{6,}+\.[A-Za-z0-9_-]{24,}+(?![\w.-])")),
    ("bearer_token", re.compile(r"(?i)\b(?:bearer|basic)\s{1,3}([A-Za-z0-9._~+/-]{12,}+=*+)")),
    ("url_password", re.compile(r"://[^\s:/?#@\"'<>]*+:([^\s/@\"'<>]{3,}+)@")),
    ("assigned", re.compile(r"(?i)\b(?:[a-z0-9_]{0,24}?)(?:password|passwd|pwd|secret|token|api_?-?key|access_?-?key|auth|credential)s?[\"']?\s{0,3}(?:=|:|:=|=>)\s{0,3}[\"']?([^\s\"',;<>]{6,}+)")),
    ("random_run", re.compile(r"(?<![A-Za-z0-9+/_.-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{24,}+={0,2}(?![A-Za-z0-9+/_=-])")),
)
KINDS = tuple(dict.fromkeys(k for k, _ in PATTERNS))
#: One cheap look tells whether a text can hold a candidate at all.
GATE = re.compile(r"(?i)AKIA|ASIA|gh[pousr]_|xox[abprs]-|[sr]k[-_]|pk[-_]|AIza|eyJ|PRIVATE KEY|passw|pwd|secret|token|api_?-?key|access_?-?key|auth|credential|bearer|basic|://[^\s:/?#@\"'<>]*+:[^\s/@\"'<>]{3,}+@|[a-z0-9+/_=-]{24}")
HINTS = ("password", "passwd", "pwd", "secret", "token", "key", "auth", "credential", "aws", "api")
HARMLESS = ("sha", "md5", "hash", "checksum", "commit", "uuid", "guid", "etag", "digest", "version", "build", "example", "sample", "test", "id", "url", "path", "file", "class", "color")
WORDS = ("password", "secret", "token", "example", "sample", "test", "change", "changeme", "your", "here", "insert", "dummy", "default", "admin", "user", "value", "none", "null", "true", "false",
         "config", "local", "host", "service", "index", "image", "static", "module", "class", "name", "file", "path", "data", "key", "string", "number", "placeholder", "todo", "redacted", "hidden", "the", "and", "for", "with", "that", "this",
         "api", "env", "get", "process", "self", "request", "response", "session", "login", "license", "version", "build", "main", "master", "branch", "http", "https", "www", "com", "org")
#: Everyday words of which made-up passwords and prose are put together.
EVERYDAY = ("apple bridge candle dragon eagle forest garden hammer island jungle kettle ladder market needle orange pencil quiet rocket silver thunder umbrella violet "
            "window yellow zebra summer winter monday friday sunshine football guitar purple monkey cookie princess shadow master soccer flower cheese orchid basket copper "
            "morning evening brother sister money house green black light stone water paper music planet tiger happy lucky crazy little strong").split()  # fmt: skip
FEATURES = ("length", "digits", "uppers", "lowers", "others", "transitions", "entropy", "distinct", "pair_score", "dictionary", "vowels", "path", "uuid", "hexadecimal", "placeholder", "repeats", "hint_near", "harmless_near", "quoted", "assigned", "kind")
_HINT, _HARMLESS = re.compile("|".join(HINTS)), re.compile(rf"\b(?:{'|'.join(HARMLESS)})\b")
_DICT = re.compile("|".join(sorted(WORDS, key=len, reverse=True)))
_UUID = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$")
_COMMON_PAIRS = frozenset("th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur".split())
NEAR = 40


def candidates(text: str) -> list[tuple[int, int, str]]:
    """(from, to, kind) of key-like strings, in order, without overlaps."""
    if not GATE.search(text):
        return []
    taken: list[tuple[int, int, str]] = []
    for kind, pattern in PATTERNS:
        for m in pattern.finditer(text):
            if kind == "jwt" and "." not in m[0]:  # its first part alone, passed over whole
                continue
            a, b = m.span(1) if m.re.groups and m[1] else m.span()
            taken.append((a, b, kind))
    rank = {k: i for i, k in enumerate(KINDS)}
    free: list[tuple[int, int, str]] = []
    for found in sorted(taken, key=lambda x: (rank[x[2]], x[0])):
        at = bisect_left(free, found)
        if (at == 0 or free[at - 1][1] <= found[0]) and (at == len(free) or found[1] <= free[at][0]):
            free.insert(at, found)
    return free


def features(value: str, before: str, after: str, kind: str) -> list[float]:
    n = len(value)
    classes = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "o" for c in value]
    count, letters = Counter(value), [c for c in value.lower() if c.isalpha()]
    low = value.lower()
    covered = sum(len(m[0]) for m in _DICT.finditer(low))
    pairs = [low[i:i + 2] for i in range(n - 1)]
    assigned = bool(re.search(r"(?:=|:)\s*[\"']?$", before[-6:]))
    return [
        min(n, 300), classes.count("d") / n, classes.count("u") / n, classes.count("l") / n, classes.count("o") / n,
        sum(a != b for a, b in zip(classes, classes[1:], strict=False)) / max(1, n - 1), -sum(v / n * math.log2(v / n) for v in count.values()), len(count) / n,
        sum(p in _COMMON_PAIRS for p in pairs) / max(1, n - 1), covered / n, sum(c in "aeiou" for c in letters) / max(1, len(letters)),
        float(value.count("/") >= 2 or "\\" in value or "." in value), float(bool(_UUID.match(value))), float(all(c in string.hexdigits for c in value)),
        float(bool(re.search(r"(?i)x{4}|\*{3}|\.{3}|<|>|\$\{|\{\{|example|changeme|your|placeholder|dummy|redacted|12345|abcdef", value))), max(count.values()) / n,
        float(bool(_HINT.search(before[-NEAR:].lower()))), float(bool(_HARMLESS.search(before[-24:].lower()))), float(before[-1:] in "\"'" and before[-1:] != "" and after[:1] == before[-1:]), float(assigned), float(KINDS.index(kind)),
    ]


def labelled_findings(n: int = 6000, seed: int = 7) -> list[tuple[str, str, str, str, int]]:
    """(value, text before, text after, kind, 1 for a secret) made from a seed, as many of each label."""
    r = np.random.default_rng(seed)
    draw = lambda alphabet, k: "".join(r.choice(list(alphabet), k))
    pick = lambda xs: xs[int(r.integers(len(xs)))]
    filler = lambda: " ".join("".join(r.choice(list("etaoinshrdlu"), int(r.integers(2, 8)))) for _ in range(int(r.integers(2, 7))))
    hexa, alnum = "0123456789abcdef", string.ascii_letters + string.digits
    long_words, pairs = [w for w in WORDS if len(w) > 2], sorted(_COMMON_PAIRS)
    word = lambda: pick(long_words)
    natural = lambda low, high: "".join(pick(pairs) for _ in range(int(r.integers(low, high))))
    everyday = lambda low, high: natural(low, high) if r.integers(3) == 0 else pick(EVERYDAY)

    def human() -> str:
        """A password as people make them."""
        k = int(r.integers(5))
        if k == 0:
            return (everyday(2, 5) + str(r.integers(1, 1000))) * 2
        if k == 1:
            return "".join(everyday(3, 5) for _ in range(int(r.integers(4, 7))))
        if k == 2:
            return everyday(3, 6).title() + str(r.integers(1, 10_000)) + pick(["!", "#", "?", "", "$"])
        if k == 3:
            return pick(["-", "_", "."]).join([everyday(2, 5), everyday(2, 5), str(r.integers(10, 10_000))])
        return everyday(2, 4).title() + pick("@$3!0") + natural(1, 3) + str(r.integers(1, 1000)) + pick(["!", "", "Pw"])

    out = []
    for i in range(n):
        a, b = filler() + " ", " " + filler()
        if i % 2:
            k = int(r.integers(21))
            if k >= 19:
                name, q = pick(["password", "passwd", "pwd", "secret", "db_password"]), pick(["", '"', "'"])
                out.append((human(), a + name + pick(["=", " = ", ": "]) + q, q + b, "assigned", 1))
            elif k == 18:
                out.append((pick([human(), draw(alnum + "!$%^*-_", int(r.integers(6, 25)))]), a + pick(["postgres", "mysql", "https", "amqp", "redis"]) + "://" + pick([word(), natural(1, 4), ""]) + ":", "@" + natural(1, 4) + b, "url_password", 1))
            elif k == 17:
                out.append((pick(["SG." + draw(alnum, 22) + "." + draw(alnum + "_-", 43), draw(alnum, 24) + "." + draw(alnum, 6) + "." + draw(alnum + "-_", int(r.integers(27, 41)))]), a + pick(["", "key ", "token "]), b, "dotted_key", 1))
            elif k >= 15:
                out.append((draw(pick([hexa, alnum, alnum + "-_", alnum + "._-", string.ascii_lowercase + string.digits]), int(r.integers(16, 81))) + pick(["", "", "=="]), a + pick(["Authorization: Bearer ", "bearer ", "Authorization: Basic ", '"Bearer ', "Bearer "]), pick([b, '"' + b]), "bearer_token", 1))
            elif k >= 12:
                # a key of its own: nothing near says what it is
                key = draw(pick([alnum, alnum, alnum + "+/", alnum + "_-"]), int(r.integers(24, 129)) if k < 14 else int(r.integers(24, 60)))
                out.append((key[:4] + "7" + key[4:] + "aQ" + pick(["", "", "=", "=="]), a + pick(["", "", "key ", "use "]), b, "random_run", 1))
            elif k == 0:
                out.append((pick(["AKIA", "ASIA"]) + draw(string.ascii_uppercase + "234567", 16), a, b, "aws_key_id", 1))
            elif k == 1:
                out.append((pick(["ghp_", "gho_"]) + draw(alnum, 36), a, b, "github_token", 1))
            elif k == 2:
                out.append((pick(["sk-", "sk_live_", "pk_live_"]) + draw(alnum, int(r.integers(20, 49))), a, b, "api_key", 1))
            elif k == 3:
                out.append(("eyJ" + draw(alnum, 33) + "." + draw(alnum, 60) + "." + draw(alnum + "-_", 43), a, b, "jwt", 1))
            elif k == 4:
                out.append((pick(["AIza" + draw(alnum, 35), "xoxb-" + draw(string.digits, 12) + "-" + draw(alnum, 24)]), a, b, pick(["google_key", "slack_token"]), 1))
            elif k == 5:
                out.append(("-----BEGIN RSA PRIVATE KEY-----" + draw(alnum + "+/", 64), a, b, "private_key", 1))
            else:
                name, q = pick(["password", "passwd", "secret", "token", "api_key", "access_key", "auth_token"]), pick(["", '"', "'"])
                value = pick([draw(hexa, int(r.integers(10, 25))), draw(hexa, int(r.integers(16, 65))), draw(alnum, int(r.integers(10, 41))), draw(alnum + "!@%^*+-", int(r.integers(10, 25)))])
                out.append((value, a + name + pick(["=", " = ", ": "]) + q, q + b, "assigned", 1))
        else:
            k = int(r.integers(19))
            if k >= 17:
                # prose and code behind a word such as secret
                name = pick(["password", "secret", "token", "credentials", "auth"])
                code = pick(["self." + name, "get_" + name + "()", natural(2, 4) + "." + name, "request.form[" + name, name + "_" + word(), "user" + name.title(), "String", "None)", "null}", "getenv(" + name.upper() + ")"])
                out.append((pick([code, everyday(3, 8), everyday(3, 8), everyday(3, 7).title(), everyday(3, 7) + "."]), a + name + pick(["=", " = ", ": "]), b, "assigned", 0))
            elif k == 16:
                many = [natural(2, 5) for _ in range(int(r.integers(6, 10)))]
                out.append((pick(["www", "com", "org", "v2", word()]) + "." + natural(3, 6) + "." + pick(["-", "_", ""]).join(many), a, b, "dotted_key", 0))
            elif k == 15:
                out.append((pick(["password", "pass", "xxxxxx", "secret", "${PASS}", "$PASSWORD", "changeme", "********", "your-password", "example", "{password}"]), a + pick(["postgres", "mysql", "https", "amqp", "redis"]) + "://" + pick(["user", "admin", "${USER}", "username", natural(1, 4)]) + ":", "@" + natural(1, 4) + b, "url_password", 0))
            elif k >= 13:
                out.append((pick([natural(6, 11), natural(6, 11), natural(3, 6) + "-" + natural(3, 6), natural(3, 6) + "/" + natural(3, 6), natural(6, 9) + ".", "YOUR_ACCESS_TOKEN", "your-token-here", "xxxxxxxxxxxxxxxx"]), a + pick(["bearer ", "basic ", "Basic ", "Bearer "]), b, "bearer_token", 0))
            elif k >= 9:
                # names and paths of mixed case, dates and dotted or long lower-case ids
                many = [word() for _ in range(int(r.integers(5, 9)))]
                camel = many[0] + "".join(w.title() for w in many[1:]) + str(r.integers(1, 100))
                dated = f"/{r.integers(1990, 2030)}/{r.integers(10, 13)}/" + "-".join(many)
                plain = "".join(r.choice(list("etaoinshrdlu"), int(r.integers(24, 60)))) + str(r.integers(10, 10_000))
                out.append((pick([camel, camel, dated, plain, "/".join(w.title() for w in many) + "2", "-".join(w.title() for w in many) + "-v2"]), a, b, "random_run", 0))
            elif k == 0:
                out.append((pick(["AKIA", "ASIA"]) + pick(["EXAMPLE" * 3, "X" * 16, "0" * 16, "IOSFODNN7EXAMPLE", "1234567890ABCDEF"])[:16], a, b, "aws_key_id", 0))
            elif k == 1:
                out.append((draw(hexa, pick([32, 40, 64])), a + pick(["commit ", "sha256 ", "md5: ", "checksum ", "digest ", "etag "]), b, "random_run", 0))
            elif k == 2:
                h = draw(hexa, 32)
                out.append((f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}", a + pick(["uuid ", "id: ", ""]), b, "random_run", 0))
            elif k == 3:
                out.append((pick(["/", ""]) + "/".join(word() for _ in range(5)) + str(r.integers(100)), a + pick(["path ", "file ", ""]), b, "random_run", 0))
            elif k == 4:
                out.append((pick(["_", "-", ""]).join(word() for _ in range(5)) + str(r.integers(1000)), a, b, "random_run", 0))
            elif k == 5:
                name, q = pick(["password", "secret", "token", "api_key"]), pick(["", '"', "'"])
                out.append((pick(["changeme", "your-password-here", "xxxxxxxxxxxx", "<password>", "${PASSWORD}", "example-token", "********", "placeholder123", "os.environ.get", "config.secret_value", "None-value", "REDACTED"]), a + name + pick(["=", ": "]) + q, q + b, "assigned", 0))
            elif k == 6:
                out.append((filler().replace(" ", "")[:14], a + pick(["token: ", "secret: ", "password: "]), b, "assigned", 0))
            elif k == 7:
                out.append((pick(["ghp_", "sk-", "sk_test_"]) + pick(["x" * 36, "example" * 6, "your" * 9, "abcdef1234567890" * 3])[:36], a, b, pick(["github_token", "api_key"]), 0))
            else:
                out.append(("".join(r.choice(list("etaoinshrdlu"), 30)) + "1", a, b, "random_run", 0))
    return out


def train_forest(x: np.ndarray, y: np.ndarray, trees: int = 32, depth: int = 9, seed: int = 11, least: int = 2) -> list[tuple[np.ndarray, ...]]:
    """Trees as arrays (feature or -1, threshold, left, right, share of secrets); Gini splits on bootstrap rows."""
    r, forest, m = np.random.default_rng(seed), [], 2 * max(1, int(math.sqrt(x.shape[1])))
    for _ in range(trees):
        nodes: list[list[float]] = []

        def grow(rows: np.ndarray, level: int, nodes=nodes) -> int:
            me = len(nodes)
            p = float(y[rows].mean())
            nodes.append([-1, 0.0, -1, -1, p])
            if level == depth or len(rows) < 2 * least or p in (0.0, 1.0):
                return me
            best = (1e9, -1, 0.0)
            for f in r.permutation(x.shape[1])[: m + 1]:
                order = rows[np.argsort(x[rows, f], kind="stable")]
                v, c = x[order, f], np.cumsum(y[order])
                cut = np.flatnonzero(v[1:] > v[:-1])
                cut = cut[(cut + 1 >= least) & (len(rows) - cut - 1 >= least)]
                if len(cut):
                    nl = cut + 1.0
                    nr = len(rows) - nl
                    pl, pr = c[cut] / nl, (c[-1] - c[cut]) / nr
                    g = nl * pl * (1 - pl) + nr * pr * (1 - pr)
                    k = int(np.argmin(g))
                    if g[k] < best[0]:
                        best = (float(g[k]), int(f), float((v[cut[k]] + v[cut[k] + 1]) / 2))
            if best[1] < 0:
                return me
            go = x[rows, best[1]] <= best[2]
            nodes[me][:2] = best[1], best[2]
            nodes[me][2] = grow(rows[go], level + 1)
            nodes[me][3] = grow(rows[~go], level + 1)
            return me

        grow(r.integers(0, len(y), len(y)), 0)
        a = np.array(nodes)
        forest.append((a[:, 0].astype(np.int32), a[:, 1], a[:, 2].astype(np.int32), a[:, 3].astype(np.int32), a[:, 4]))
    return forest


def forest_scores(forest, x: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x))
    for feature, cut, left, right, share in forest:
        at = np.zeros(len(x), np.int32)
        while True:
            inner = np.flatnonzero(feature[at] >= 0)
            if not len(inner):
                break
            node = at[inner]
            at[inner] = np.where(x[inner, feature[node]] <= cut[node], left[node], right[node])
        total += share[at]
    return total / max(1, len(forest))


def trained(findings=None, max_findings: int = 6000, **forest):
    rows = list(labelled_findings() if findings is None else findings)[:max_findings]
    x = np.array([features(*row[:4]) for row in rows])
    return train_forest(x, np.array([row[4] for row in rows], float), **forest)


FOUND = T.ArrayType(T.StructType([T.StructField("from", T.LongType()), T.StructField("to", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("score", T.DoubleType())]))


def find_secrets(texts: list[str | None], forest, threshold: float = 0.5) -> list[tuple[int, list[dict]]]:
    """For each text its number of candidates and the findings the forest keeps."""
    where, rows = [], []
    for i, text in enumerate(texts):
        for a, b, kind in candidates(text) if text else ():
            where.append((i, a, b, kind))
            rows.append(features(text[a:b], text[max(0, a - NEAR):a], text[b:b + NEAR], kind))
    out: list[tuple[int, list[dict]]] = [(0, []) for _ in texts]
    if rows:
        for (i, a, b, kind), score in zip(where, forest_scores(forest, np.array(rows)), strict=True):
            n, kept = out[i]
            if score >= threshold:
                kept.append({"from": a, "to": b, "kind": kind, "score": float(score)})
            out[i] = (n + 1, kept)
    return out


def scan_secrets(docs: DataFrame, findings=None, threshold: float = 0.5) -> DataFrame:
    """doc_id, n_candidates, secrets (character spans, kind and score)."""
    forest = trained(findings)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("secrets")
        for batch in batches:
            found = find_secrets(batch.column("text").to_pylist(), forest, threshold)
            spans = pa.array([x[1] for x in found], pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64()), ("kind", pa.string()), ("score", pa.float64())])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x[0] for x in found], pa.int64()), spans], names=["doc_id", "n_candidates", "secrets"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_candidates long, secrets {FOUND.simpleString()}")


def redact(docs: DataFrame, findings=None, threshold: float = 0.5, mark: str = "[{kind}]") -> DataFrame:
    """The same rows and columns, each secret replaced by its mark; an n_chars column is counted anew for them."""
    forest = trained(findings)
    names, schema = docs.columns, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("secrets")
        for batch in batches:
            texts = batch.column("text").to_pylist()
            changed: dict[int, str] = {}
            for i, (_, kept) in enumerate(find_secrets(texts, forest, threshold)):
                if kept:
                    parts, at = [], 0
                    for f in kept:
                        parts += [texts[i][at:f["from"]], mark.format(kind=f["kind"])]
                        at = f["to"]
                    changed[i] = "".join(parts) + texts[i][at:]
            if changed:
                columns = dict(zip(names, batch.columns, strict=True))
                columns["text"] = pa.array([changed.get(i, t) for i, t in enumerate(texts)], columns["text"].type)
                if "n_chars" in columns:
                    n = columns["n_chars"].to_pylist()
                    columns["n_chars"] = pa.array([len(changed[i]) if i in changed else x for i, x in enumerate(n)], columns["n_chars"].type)
                batch = pa.RecordBatch.from_arrays([columns[k] for k in names], names=names)
            yield batch

    return docs.mapInArrow(run, schema)


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("secrets", lambda s: F.concat_ws(":", s["kind"], s["from"].cast("string"), s["to"].cast("string"))), ",")
    return found.select("doc_id", "n_candidates", F.size("secrets").cast("long").alias("n_secrets"), spans.alias("findings"), F.coalesce(F.array_max("secrets.score"), F.lit(0.0)).alias("score"), (F.size("secrets") > 0).alias("has_secret"))
