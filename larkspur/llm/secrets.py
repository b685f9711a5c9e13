"""Secret scans: a character convolutional network in numpy over every candidate and its context.

Candidates are all runs of SHORTEST or more key characters that have a digit, values of 8 characters or more
after a word like "password" or "token" and a sign of assignment, and headers of private keys. Each is read whole,
with the BEFORE and AFTER characters around it: learned character vectors with a mark for before, inside and after;
WIDTH-wide filters with ReLU; the maximum of each filter over each of the three parts; a logistic layer. The maximum
takes any length, so every character of a long candidate is convolved, in pieces of PIECE positions; candidates of
like length are read together, and padding never counts.

It is trained on labelled findings: keys, tokens and passwords of public formats with random characters (positive),
and words, numbers, checksums, commit ids, addresses, file names and versions (negative), set into contexts cut from
a sample of at most about SAMPLE_DOCS documents. Of a held-out third, one half fits the calibration (a logistic
curve over the logit), and the threshold is the largest calibrated probability with a recall of RECALL on both.

Defined results: NULL and empty texts have no findings; an empty table gives no rows. Repeated rows each have their
findings, as have rows without a doc_id. Very long texts and candidates are read whole. A probability that equals the
threshold is a finding. Positions count characters from 0. The secret itself isn't returned, but its first 4 characters. Other
columns are ignored.
"""

from __future__ import annotations

import re
import string

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SHORTEST = 16
SAMPLE_DOCS = 400
FINDINGS = 6000
RECALL = 0.99
BEFORE, AFTER = 24, 12
INSIDE, SHORT = 128, 56  # room for a candidate and its padding: of labelled findings, and of the shortest class
CHARS, FILTERS, WIDTH = 8, 32, 5
PIECE = 4096
SCHEMA = "doc_id bigint, first int, last int, preview string, probability double"

_KEY = r"A-Za-z0-9_\-+/=.~"
CANDIDATE = re.compile(
    rf"(?<![{_KEY}])(?=[A-Za-z_\-+/=.~]*\d)[{_KEY}]{{{SHORTEST},}}"
    r"|(?=[\"'\s=:])(?i:(?<=pass)|(?<=password)|(?<=passwd)|(?<=pwd)|(?<=secret)|(?<=token)|(?<=key)|(?<=auth))[\"']?\s{0,3}[=:]{1,2}\s{0,3}[\"']?(?P<value>[^\s\"',;<>]{8,})"
    r"|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"
)


def candidates(text: str | None) -> list[tuple[int, int]]:
    """(first, last + 1) of each candidate of a text."""
    return [m.span("value") if m["value"] is not None else m.span() for m in CANDIDATE.finditer(text)] if text else []


_CODE = np.full(0x10000, 2, np.uint8)  # 0 pads, 2 is any other character, 1 white space
for _i, _c in enumerate(map(ord, string.digits + string.ascii_letters + string.punctuation)):
    _CODE[_c] = 3 + _i
_CODE[[9, 10, 11, 12, 13, 32]] = 1
ALPHABET = 3 + 10 + 52 + 32


def windows(found: list[tuple[str, int, int]], inside: int = INSIDE) -> np.ndarray:
    """Character numbers of each candidate (text, first, last + 1): before, inside (at most inside - WIDTH // 2), after."""
    rows = [text[max(0, lo - BEFORE) : lo].rjust(BEFORE, "\0") + text[lo:hi].ljust(inside, "\0") + text[hi : hi + AFTER].ljust(AFTER, "\0") for text, lo, hi in found]
    codes = np.frombuffer("".join(rows).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, BEFORE + inside + AFTER)
    out = _CODE[np.minimum(codes, 0xFFFF)]
    out[codes == 0] = 0
    return out


def _parts(size: int) -> list[tuple[int, int]]:
    return [(0, BEFORE), (BEFORE, size - AFTER), (size - AFTER, size)]


class Network:
    def __init__(self, rng: np.random.Generator):
        self.char = rng.normal(0, 0.3, (ALPHABET, CHARS)).astype(np.float32)
        self.filters = rng.normal(0, 0.2, (WIDTH * (CHARS + 3), FILTERS)).astype(np.float32)
        self.floor = np.zeros(FILTERS, np.float32)
        self.out = rng.normal(0, 0.1, 3 * FILTERS).astype(np.float32)
        self.bias = np.zeros(1, np.float32)
        self.slope, self.shift, self.threshold = 1.0, 0.0, 0.5

    def _columns(self, codes: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """What the filters see at the positions from lo to hi: WIDTH characters with their marks, end to end."""
        n, size, half = len(codes), codes.shape[1], WIDTH // 2
        x = np.zeros((n, hi - lo + WIDTH - 1, CHARS + 3), np.float32)
        first, last = max(0, lo - half), min(size, hi + half)
        seen = codes[:, first:last]
        at = slice(first - lo + half, last - lo + half)
        x[:, at, :CHARS] = self.char[seen] * (seen > 0)[:, :, None]
        x[:, at, CHARS:] = np.eye(3, dtype=np.float32)[np.repeat([0, 1, 2], [b - a for a, b in _parts(size)])[first:last]]
        return np.concatenate([x[:, j : j + hi - lo] for j in range(WIDTH)], 2)

    def _act(self, codes: np.ndarray, lo: int, hi: int, keep: bool = False):
        col = self._columns(codes, lo, hi)
        act = np.maximum(col.reshape(-1, col.shape[2]) @ self.filters + self.floor, 0).reshape(len(codes), hi - lo, FILTERS)
        act *= (codes[:, lo:hi] > 0)[:, :, None]
        return (col, act) if keep else act

    def logits(self, codes: np.ndarray, keep: bool = False):
        size = codes.shape[1]
        if keep:
            col, act = self._act(codes, 0, size, True)
            top = np.concatenate([act[:, a:b].max(1) for a, b in _parts(size)], 1)
        else:
            top = np.zeros((len(codes), 3 * FILTERS), np.float32)
            for part, (a, b) in enumerate(_parts(size)):
                best = top[:, part * FILTERS : (part + 1) * FILTERS]
                for lo in range(a, b, PIECE):
                    np.maximum(best, self._act(codes, lo, min(lo + PIECE, b)).max(1), out=best)
        z = top @ self.out + self.bias[0]
        return (z, col, act, top) if keep else z

    def gradients(self, codes: np.ndarray, y: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        z, col, act, top = self.logits(codes, True)
        size = codes.shape[1]
        dz = (1 / (1 + np.exp(-z)) - y).astype(np.float32) / len(y)
        dtop = dz[:, None] * self.out
        dact = np.zeros_like(act)
        n = np.arange(len(codes))[:, None]
        for part, (lo, hi) in enumerate(_parts(size)):
            best = act[:, lo:hi].argmax(1) + lo
            dact[n, best, np.arange(FILTERS)] = dtop[:, part * FILTERS : (part + 1) * FILTERS]
        dact *= act > 0
        flat = dact.reshape(-1, FILTERS)
        dcol = (flat @ self.filters.T).reshape(len(codes), size, WIDTH, CHARS + 3)
        dchar = np.zeros_like(self.char)
        for j in range(WIDTH):
            shift = j - WIDTH // 2
            lo, hi = max(0, -shift), min(size, size - shift)
            seen = codes[:, lo + shift : hi + shift]
            grad = dcol[:, lo:hi, j, :CHARS]
            for c in range(CHARS):
                dchar[:, c] += np.bincount(seen.ravel(), grad[:, :, c].ravel(), ALPHABET)
        dchar[0] = 0
        return [(self.char, dchar), (self.filters, col.reshape(-1, col.shape[2]).T @ flat), (self.floor, flat.sum(0)), (self.out, top.T @ dz), (self.bias, dz.sum(keepdims=True))]

    def probabilities(self, codes: np.ndarray) -> np.ndarray:
        step = max(1, 512 * SHORT // codes.shape[1])
        parts = [self.logits(codes[k : k + step]) for k in range(0, len(codes), step)]
        z = np.concatenate(parts).astype(np.float64) if parts else np.zeros(0)
        return 1 / (1 + np.exp(-(self.slope * z + self.shift)))

    def judged(self, found: list[tuple[str, int, int]]) -> np.ndarray:
        """The probability of each candidate (text, first, last + 1), of any length."""
        out, width = np.zeros(len(found)), SHORT
        length = np.fromiter((hi - lo for _, lo, hi in found), np.int64, len(found)) + WIDTH // 2
        left = np.ones(len(found), bool)
        while left.any():
            rows = np.flatnonzero(left & (length <= width))
            step = max(1, (1 << 22) // width)
            for k in range(0, len(rows), step):
                out[rows[k : k + step]] = self.probabilities(windows([found[r] for r in rows[k : k + step]], width))
            left[rows] = False
            width *= 2
        return out


def labelled_findings(texts: list[str], n: int, rng: np.random.Generator) -> tuple[list[tuple[str, int, int]], np.ndarray]:
    """Secrets and look-alikes by construction, in contexts cut from texts."""
    lower, upper, digits, alnum, hexa = string.ascii_lowercase, string.ascii_uppercase, string.digits, string.ascii_letters + string.digits, "0123456789abcdef"
    of = lambda chars, size: "".join(np.array(list(chars))[rng.integers(0, len(chars), size)])
    pick = lambda *xs: xs[rng.integers(len(xs))]
    words = [w for t in texts for w in t.split()] or ["text"]
    word = lambda: re.sub(r"[^\w]", "", words[rng.integers(len(words))]) or "text"
    name = lambda: pick("token", "api_key", "apikey", "secret", "auth_token", "access_key", "client_secret", "private_key", "secret_key", "bearer token")
    give = lambda k, v: k + pick(" = ", "=", ": ", " := ", ' : ') + pick('"{}"', "'{}'", "{}").format(v)

    def secret() -> tuple[str, str]:
        kind = rng.integers(9)
        if kind <= 1:
            v = of(hexa, pick(32, 40, 48, 64))
            return give(name(), v), v
        if kind == 2:
            v = "AKIA" + of(upper + "234567", 16)
            return pick(v, give("aws_access_key_id", v)), v
        if kind == 3:
            v = pick("ghp_", "gho_", "ghs_", "glpat-", "npm_") + of(alnum, 36)
            return pick(v, give(name(), v)), v
        if kind == 4:
            v = pick("sk-", "sk_live_", "rk_live_", "xoxb-", "SG.", "AIza") + of(alnum + "_-", pick(24, 35, 48))
            return pick(v, give(name(), v)), v
        if kind == 5:
            v = "eyJ" + of(alnum, 20) + ".eyJ" + of(alnum, 30) + "." + of(alnum + "_-", 43)
            return pick("Bearer " + v, v, give("jwt", v)), v
        if kind == 6:
            v = of(alnum + "+/", pick(32, 40, 44)) + pick("", "=")
            return give(name(), v), v
        if kind == 7:
            v = of(alnum + "!#%&*_-", int(rng.integers(10, 20)))
            return give(pick("password", "passwd", "pwd", "db_password"), v), v
        v = "-----BEGIN " + pick("RSA ", "EC ", "OPENSSH ", "") + "PRIVATE KEY-----"
        return v, v

    def harmless() -> tuple[str, str]:
        kind = rng.integers(11)
        if kind == 0:
            v = of(digits, int(rng.integers(16, 20)))
            return pick(v, "+" + v, "no. " + v), v
        if kind == 1:
            v = of(hexa, pick(32, 40, 64))
            return pick("commit ", "sha1 ", "sha256: ", "md5 ", "checksum ", "etag ", "revision ") + v, v
        if kind == 2:
            v = "-".join(of(hexa, k) for k in (8, 4, 4, 4, 12))
            return pick("id ", "uuid ", "") + v, v
        if kind == 3:
            v = pick("/usr/lib/", "/home/", "src/", "img/") + "/".join(word() for _ in range(3)) + of(digits, 2) + pick(".py", ".png", ".html")
            return v, v
        if kind == 4:
            v = f"{word()}-{word()}-{rng.integers(10)}.{rng.integers(30)}.{rng.integers(100)}" + pick("", ".tar.gz", "-release")
            return v.ljust(SHORTEST, "0"), v.ljust(SHORTEST, "0")
        if kind == 5:
            v = f"20{rng.integers(10, 30)}-0{rng.integers(1, 10)}-1{rng.integers(10)}T1{rng.integers(10)}:"[:-1] + "-00-00.000"
            return v, v
        if kind == 6:
            v = of(lower, 1) + word() + word() + word() + of(digits, int(rng.integers(1, 4)))
            return v.ljust(SHORTEST, "n"), v.ljust(SHORTEST, "n")
        if kind == 7:
            v = f"mail{rng.integers(10)}.{word()}.example" + pick(".com", ".org", ".net")
            return f"{rng.integers(100)}@" + v, v
        if kind == 8:
            v = pick("your_password_here", "changeme_changeme", "<your-token>", "os.environ", "placeholder", "required", "optional.", word() + word())
            return pick("password", "token", "secret", "key") + pick(": ", " = ") + v, v
        if kind == 9:
            v = "=" * int(rng.integers(16, 40)) + of(digits, 1) + "-" * 4
            return v, v
        v = f"{of(digits, 3)}.{of(digits, 3)}.{of(digits, 2)}.{of(digits, 3)}" + pick("-", "/") + of(digits, 4)
        return v, v

    found, y = [], np.arange(n) % 2
    for label in y:
        phrase, value = secret() if label else harmless()
        case = rng.integers(12)
        if case == 0 and not value.startswith("-----"):
            phrase, value = phrase.upper(), value.upper()
        t = texts[rng.integers(len(texts))] if texts else ""
        cut = int(rng.integers(len(t) + 1))
        text = t[max(0, cut - 40) : cut] + pick(" ", "\n") + phrase + pick("", "", "", ".", ",", "###", "!!", "%%%") + pick(" ", "\n") + t[cut : cut + 40]
        at = text.index(phrase, min(40, cut)) + phrase.rindex(value)
        found.append((text, at, at + len(value)))
    return found, y


def train(texts: list[str], findings: int = FINDINGS, epochs: int = 5, seed: int = 9) -> Network:
    rng = np.random.default_rng(seed)
    found, y = labelled_findings(texts, findings, rng)
    codes = windows(found)
    fold = rng.permutation(len(y)) % 6  # 0 calibrates, 1 and 0 set the threshold
    learn = np.flatnonzero(fold >= 2)
    net = Network(rng)
    first, second, step = {}, {}, 0
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(learn), max(1, len(learn) // 64)):
            step += 1
            for i, (w, g) in enumerate(net.gradients(codes[part], y[part])):
                first[i] = 0.9 * first.get(i, 0) + 0.1 * g
                second[i] = 0.999 * second.get(i, 0) + 0.001 * g * g
                w -= (0.004 * first[i] / (1 - 0.9**step) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    z, t = net.logits(codes[fold == 0]).astype(float), y[fold == 0]
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps of a regularised logistic fit
        p = 1 / (1 + np.exp(-(a * z + b)))
        w = np.maximum(p * (1 - p), 1e-6)
        g = np.array([((p - t) * z).sum() + 0.01 * (a - 1), (p - t).sum() + 0.01 * b])
        h = np.array([[(w * z * z).sum() + 0.01, (w * z).sum()], [(w * z).sum(), w.sum() + 0.01]])
        move = np.linalg.solve(h, g)
        a, b = a - np.clip(move[0], -0.5, 0.5), b - np.clip(move[1], -0.5, 0.5)
    net.slope, net.shift = float(max(a, 1e-3)), float(b)
    judged = fold <= 1
    good = np.sort(net.probabilities(codes[judged])[y[judged] == 1])
    net.threshold = float(min(good[int(len(good) * (1 - RECALL))], 0.9)) if len(good) else 0.5
    return net


def fit(docs: DataFrame) -> Network:
    texts = common.bounded_sample(docs.filter("length(text) > 0").select("doc_id", "text"), F.col("doc_id"), SAMPLE_DOCS)
    return train([r["text"] for r in texts.orderBy("doc_id", common.text_key("text")).collect()])


def findings(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, first, last, preview, probability) of each candidate that passes the threshold."""
    shared = common.ready(docs.sparkSession).sparkContext.broadcast(net)

    def run(batch):
        found, rows = [], []
        for i, text in enumerate(batch.column("text").to_pylist()):
            for lo, hi in candidates(text):
                found.append((text, lo, hi))
                rows.append(i)
        if not found:
            return None
        p = shared.value.judged(found)
        good = np.flatnonzero(p >= shared.value.threshold)
        return {
            "doc_id": batch.column("doc_id").take(np.array(rows)[good]), "first": [found[g][1] for g in good], "last": [found[g][2] - 1 for g in good],
            "preview": [found[g][0][found[g][1] : found[g][1] + 4] for g in good], "probability": np.round(p[good], 4),
        }

    return common.map_arrow(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), run, SCHEMA)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.load(spark, sf_dir, "documents", spread=True)
    return findings(docs, fit(docs))
