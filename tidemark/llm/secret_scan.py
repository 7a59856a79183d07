"""Secret scans: a random forest over candidates removes the false positives of a broad search.

Candidates are long runs of key characters, shorter ones up to two words after a hint word, and whatever a hint word is
set to (`password=`, `"token": "`), marks too: the forest decides. Features: length,
transitions between character classes, how much of it a word list covers, the path around it and the neighbouring
words. The forest is trained on labelled findings; `labelled_findings` makes a seeded set, and others can be passed.

Defined results: null or empty texts have no candidates; a text may hold any number; repeated rows are scanned
each; an empty table gives no rows; extra columns are ignored by `scan` and kept by `redact`.
"""

from __future__ import annotations

import json
import random
import re
import string
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import batches, stored, texts, tidy, utf8
from tidemark.llm.quality import Trees

FINDINGS = "doc_id long, start_byte long, end_byte long, length int, preview string, score double, secret boolean"
LEAST = 12  # characters of a candidate
SHORT = 6  # of one after a hint word
BETWEEN = 2  # words between a hint word and its candidate at most
NEAR = 48  # bytes looked at on either side
MASK = "[SECRET]"

_KEY = np.isin(np.arange(256), [ord(c) for c in string.ascii_letters + string.digits + "_-+/."])
_WORD = np.isin(np.arange(256), [ord(c) for c in string.ascii_letters + "_"])
_CLASS = np.full(256, 4, np.uint8)  # 0 digit, 1 lower, 2 upper, 3 joiner, 4 other
for _k, _cs in enumerate((string.digits, string.ascii_lowercase, string.ascii_uppercase, "_-+/.")):
    for _c in _cs:
        _CLASS[ord(_c)] = _k

# Words that tell of a secret, and words that tell of something else.
HINTS = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "key", "auth", "bearer", "credential", "private", "aws", "access")
_HINT = re.compile(b"(?i)(?:" + "|".join(HINTS).encode() + b")[a-z_]*")
_TIE = re.compile(rb"[\"'`\])]*[ \t]*(?::=|=>|==|=|:)[ \t\r\n]*([\"'`]?)|[ \t]*([\"'`])")
_QUOTED = re.compile(rb"[!#-&(-_a-~]{%d,}" % SHORT)
_MARKED = re.compile(rb"[A-Za-z0-9_+/.!@$#%%^*~?=-]{%d,}" % SHORT)
OTHERS = ("sha", "commit", "md5", "checksum", "hash", "uuid", "id", "version", "isbn", "phone", "example", "sample", "digest", "build", "ref")


@lru_cache(maxsize=2)
def word_list(path: str) -> frozenset[str]:
    """Whole lower-case words of three letters or more of a public word-level vocabulary file."""
    vocab = json.load(open(path))["model"]["vocab"]
    return frozenset(w[:-4] for w in vocab if w.endswith("</w>") and len(w) >= 7 and w[:-4].isascii() and w[:-4].isalpha())


def word_cover(text: str, words: frozenset[str]) -> float:
    """The share of letters and digits in words, taken greedily, longest first."""
    low, i, hit = text.lower(), 0, 0
    total = sum(c.isalnum() for c in low)
    while i < len(low):
        for n in range(min(14, len(low) - i), 2, -1):
            if low[i : i + n] in words:
                hit, i = hit + n, i + n - 1
                break
        i += 1
    return hit / max(1, total)


def features(value: str, before: str, after: str, words: frozenset[str]) -> list[float]:
    kinds = _CLASS[np.frombuffer(value.encode("utf-8", "replace"), np.uint8)]
    n = len(kinds)
    share = np.bincount(kinds, minlength=5) / n
    steps = np.bincount(kinds[:-1].astype(int) * 5 + kinds[1:], minlength=25) if n > 1 else np.zeros(25)
    switches = steps.sum() - steps[[0, 6, 12, 18, 24]].sum()
    _, counts = np.unique(np.frombuffer(value.encode(), np.uint8), return_counts=True)
    p = counts / n
    near = re.findall(r"[a-z_]+", before.lower())[-3:]
    last = before[-1:] or " "
    hexed = all(c in "0123456789abcdefABCDEF" for c in value)
    runs = max((len(m[0]) for m in re.finditer(r"(.)\1*", value)), default=1)
    return [
        np.log(n), share[0], share[1], share[2], share[3], switches / n, float(-(p * np.log2(p)).sum()), word_cover(value, words), float(hexed), runs / n,
        float(any(h in w for w in near for h in HINTS)), float(any(w in OTHERS for w in near)), float(last in "=:\"'`"), float(last in "/\\@.#"), float(after[:1] in ("/", "@", ".") and after[1:2].isalnum()),
        value.count(".") / n, value.count("/") / n, value.count("-") / n, float(bool(re.match(r"[0-9a-f]{8}-[0-9a-f]{4}-", value.lower()))), float(bool(re.match(r"[A-Z]{3,5}[A-Z0-9_]{12}|[a-z]{2,4}_[A-Za-z0-9]", value))),
    ]


_COMMON = "correct horse battery staple summer winter dragon monkey coffee river mountain purple orange silver garden window rocket tiger planet ocean thunder shadow castle guitar pepper cookie sunshine wizard falcon marble copper forest cloud banana engine bridge candle pirate lemon violet anchor".split()
_PROSE = "features management required information available different generally configuration authentication understanding administrator performance internationalization characteristics documentation questions development services yesterday something because through another between without question example resource signature exchange approach".split()
_CODE = "None null true false undefined required optional string String default getenv os.environ process.env.TOKEN config.password self.password args.token request.headers values settings.SECRET_KEY options.auth get_password user.token password username changeme hidden redacted".split()


def labelled_findings(n: int = 4000, seed: int = 7) -> list[tuple[str, str, str, int]]:
    """(candidate, text before, text after, 1 if a secret): a seeded set with both kinds."""
    r = random.Random(seed)
    pick = lambda cs, k: "".join(r.choice(cs) for _ in range(k))
    hexa, b64 = string.digits + "abcdef", string.ascii_letters + string.digits
    syll = ["the", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it", "st", "io", "le", "is", "ou", "ar", "as", "de", "rt", "ve"]
    word = lambda k: "".join(r.choice(syll) for _ in range(k))
    plain = lambda: " ".join(word(r.randint(1, 4)) for _ in range(4))
    out = []
    for _ in range(n):
        key = r.choice(["password", "passwd", "secret", "token", "api_key", "auth_token", "client_secret", "access_key", "pwd"])
        tie = r.choice(["=", ": ", " = \"", "='", ": \"", " "])
        kind = r.randrange(6)
        if kind == 0:
            out.append(("AKIA" + pick(string.ascii_uppercase + string.digits, 16), plain() + r.choice([" ", "=", ": "]), " " + plain(), 1))
        elif kind == 1:
            out.append((pick(hexa, r.choice([16, 18, 20, 24, 32, 40, 64])), f"{plain()} {key}{tie}", r.choice(['" ', " ", "\n"]) + plain(), 1))
        elif kind == 2:
            out.append((pick(b64, r.randint(16, 48)), f"{plain()} {key}{tie}", r.choice(['" ', " ", "\n"]) + plain(), 1))
        elif kind == 3:
            out.append((r.choice(["ghp_", "gho_", "sk_live_", "xoxb-", "glpat-"]) + pick(b64, r.randint(20, 40)), plain() + r.choice([" ", "=", ": ", "\""]), " " + plain(), 1))
        elif kind == 4:
            out.append((pick(b64 + "+/", r.randint(24, 60)), f"Authorization: Bearer{r.choice([' ', ': '])}", "\n" + plain(), 1))
        else:
            out.append(("eyJ" + pick(b64 + "_-", 30) + "." + pick(b64 + "_-", 40) + "." + pick(b64 + "_-", 43), plain() + r.choice([" ", "=", ": "]), " ", 1))
        tied, after = r.choice([("=", " "), ("='", "' "), ('="', '" '), (': "', '" '), ('": "', '", '), (" = ", "\n"), (": ", "\n")])
        kind = r.randrange(4)
        leet = str.maketrans("aeios", "43105")
        common = r.choice(_COMMON)
        if kind == 0:
            value = (common if r.random() < 0.5 else word(r.randint(2, 4))).translate(leet) + pick(string.digits, r.randint(1, 4))
            value = value.capitalize() if r.random() < 0.6 else value
        elif kind == 1:
            value = pick(string.ascii_letters, r.randint(8, 24))
        elif kind == 2:
            value = r.choice(["", "", "-", "_"]).join(r.choice(_COMMON) if r.random() < 0.7 else word(3) for _ in range(r.randint(3, 6)))
        else:
            value = pick(b64, r.randint(3, 8)) + r.choice("!@$#%") + pick(b64 + "!@$#%^&*", r.randint(3, 9))
        out.append((value, f"{plain()} {key}{tied}", after + plain(), 1))
        kind = r.randrange(5)
        if kind == 0:
            out.append((r.choice(_PROSE) if r.random() < 0.6 else word(r.randint(3, 8))[: r.randint(6, 16)].ljust(6, "e"), f"{plain()} {key} " + r.choice(["", "", "is ", "for the "]), r.choice([" ", ", "]) + plain(), 0))
        elif kind == 1:
            out.append((r.choice([c for c in _CODE if len(c) >= SHORT]), f"{plain()} {key}{tied}", r.choice(["(", after, "["]) + plain(), 0))
        elif kind == 2:
            shape = r.choice([str.lower, str.upper, str.capitalize])
            out.append((shape("".join(word(1) for _ in range(r.randint(6, 12))).ljust(LEAST, "n")), shape(plain()) + r.choice([" ", "!! ", " $$", ", "]), r.choice([" ", ",", "!! "]) + plain(), 0))
        elif kind == 3:
            out.append((r.choice(["www.", ""]) + "/".join(word(r.randint(2, 4)) for _ in range(r.randint(2, 4))), plain() + r.choice([" ", "://", "/"]), " " + plain(), 0))
        else:
            out.append(("".join(word(r.randint(1, 3)).capitalize() for _ in range(r.randint(3, 5))) if r.random() < 0.5 else r.choice("-_").join(word(2) for _ in range(4)), plain() + r.choice([" ", " new "]), r.choice(["(", " ", "."]) + plain(), 0))
        kind = r.randrange(12)
        end = " " + plain()
        if kind == 0:
            out.append((pick(hexa, 40), r.choice(["commit ", "sha ", "ref ", "sha256: ", "checksum "]), end, 0))
        elif kind == 1:
            out.append((f"{pick(hexa, 8)}-{pick(hexa, 4)}-4{pick(hexa, 3)}-{pick(hexa, 4)}-{pick(hexa, 12)}", r.choice([plain() + " ", "id: ", "uuid "]), end, 0))
        elif kind == 2:
            out.append((".".join(str(r.randint(1, 255)) for _ in range(4)), plain() + " ", end, 0))
        elif kind == 3:
            out.append((pick(string.digits, r.randint(12, 16)), plain() + " ", end, 0))
        elif kind == 4:
            host = word(r.randint(2, 4)) + r.choice(["", str(r.randint(1, 99))])
            out.append((f"{host}.{word(r.randint(2, 4))}.{r.choice(['com', 'org', 'net', 'de', 'fr', 'io', 'co.uk'])}", f"{plain()} {word(3)}@", end, 0))
        elif kind == 5:
            out.append(("/".join([word(2), word(3), str(r.randint(1, 99999))]), "https://" + word(2) + ".com/", end, 0))
        elif kind == 6:
            out.append((word(r.randint(6, 10)) + str(r.randint(0, 99)), plain() + " ", end, 0))
        elif kind == 7:
            out.append((r.choice(["example", "changeme", "your", "test", "dummy"]) + "_" + r.choice(["password", "token", "key", "secret"]) + str(r.randint(1, 999)), f"{key}{tie}", end, 0))
        elif kind == 8:
            out.append((f"{r.randint(1990, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}" + r.choice(["T10", "-v2"]), plain() + " ", end, 0))
        elif kind == 9:
            out.append((r.choice("0xX*") * r.randint(12, 30) + "0", f"{key}{tie}", end, 0))
        elif kind == 10:
            out.append((word(3).capitalize() + word(3).capitalize() + word(3).capitalize() + "Factory" + str(r.randint(1, 9)), plain() + " ", end, 0))
        else:
            parts = [str(r.randint(10 ** (k - 1), 10**k - 1)) for k in r.choice([(3, 3, 4), (3, 4, 4), (2, 2, 7), (4, 6, 2), (2, 3, 3, 4)])]
            out.append((r.choice(["", "+", "0"]) + r.choice(["-", "-", "."]).join(parts), plain() + r.choice([" ", " tel ", " call "]), end, 0))
    return out


def forest(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 9, seed: int = 11) -> Trees:
    """A random forest as flat node arrays; margin() is the mean of the leaves."""
    rng = np.random.default_rng(seed)
    tries = max(1, int(np.sqrt(x.shape[1])) + 1)
    nodes: list[list] = []
    roots = []

    def grow(rows: np.ndarray, left: int) -> int:
        me, p = len(nodes), y[rows].mean()
        nodes.append([0, np.inf, me, me, p / trees])
        best = (1e-9, 0, 0.0)
        for f in rng.permutation(x.shape[1])[:tries] if left and 0 < p < 1 else ():
            v = x[rows, f]
            for cut in np.unique(np.quantile(v, rng.random(12))):
                goes = v <= cut
                a = goes.sum()
                if 0 < a < len(rows):
                    pa_, pb = y[rows[goes]].mean(), y[rows[~goes]].mean()
                    gain = p * (1 - p) - (a * pa_ * (1 - pa_) + (len(rows) - a) * pb * (1 - pb)) / len(rows)
                    best = max(best, (gain, f, cut))
        if best[0] > 1e-9:
            goes = x[rows, best[1]] <= best[2]
            a, b = grow(rows[goes], left - 1), grow(rows[~goes], left - 1)
            nodes[me][:4] = [best[1], best[2], a, b]
        return me

    for _ in range(trees):
        roots.append(grow(rng.integers(0, len(y), len(y)), depth))
    a = np.array(nodes, float)
    return Trees(a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4], np.array(roots), depth, 0.0, 0.5)


def train(words: frozenset[str], findings: list[tuple[str, str, str, int]] | None = None) -> Trees:
    rows = labelled_findings() if findings is None else findings
    x = np.array([features(v, b, a, words) for v, b, a, _ in rows])
    return forest(x, np.array([r[3] for r in rows], float))


def hinted(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends of the hint words, and starts and ends of the runs they are set to."""
    raw, ends, runs = data.tobytes(), [], []
    for lo, hi in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
        done = lo
        for m in _HINT.finditer(raw, lo, hi):
            ends.append(m.end())
            if m.start() >= done and (tie := _TIE.match(raw, m.end(), hi)):
                run = (_QUOTED if tie[1] or tie[2] else _MARKED).match(raw, tie.end(), hi)
                if run and run.end() - (raw[run.end() - 1] == ord(".")) - run.start() >= SHORT:
                    done = run.end()
                    runs.append((run.start(), done - (raw[done - 1] == ord("."))))
    at = np.array(runs, np.int64).reshape(-1, 2)
    return np.array(ends, np.int64), at[:, 0], at[:, 1]


def candidates(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs worth scoring."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = _KEY[data]
    border = np.zeros(len(data) + 1, bool)
    border[offs] = True
    start, end = key.copy(), np.zeros(len(data) + 1, bool)
    start[1:] &= ~key[:-1] | border[1:-1]
    end[1:] = key
    end[1:-1] &= ~key[1:] | border[1:-1]
    s, e = np.flatnonzero(start), np.flatnonzero(end)
    dot = (data[e - 1] == ord(".")) if len(e) else np.zeros(0, bool)  # the sentence's, not the candidate's
    e = e - dot
    some = e - s >= SHORT
    s, e = s[some], e[some]
    hints, first, last = hinted(data, offs)
    near = np.zeros(len(s), bool)
    if len(hints) and len(s):
        h = hints[np.maximum(np.searchsorted(hints, s, side="right") - 1, 0)]
        word = _WORD[data]
        opens = word.copy()
        opens[1:] &= ~word[:-1]
        opened = np.concatenate([[0], np.cumsum(opens)])
        row = lambda x: np.searchsorted(offs, x, side="right")
        near = (h <= s) & (s - h <= NEAR) & (row(h - 1) == row(s)) & (opened[s] - opened[np.minimum(h, s)] <= BETWEEN)
    keep = (e - s >= LEAST) | near
    if len(first):  # a run with marks stands for those in it
        own = np.searchsorted(first, e - 1, side="right") - 1
        keep &= (own < 0) | (s >= last[np.maximum(own, 0)])
    s, e = np.concatenate([s[keep], first]), np.concatenate([e[keep], last])
    order = np.argsort(s, kind="stable")
    return s[order], e[order]


def found(col: pa.Array, model: Trees, words: frozenset[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end byte (in the row) and score of every candidate."""
    data, offs = utf8(col)
    s, e = candidates(data, offs)
    row = np.searchsorted(offs, s, side="right") - 1
    x = []
    for i, (a, b) in enumerate(zip(s.tolist(), e.tolist(), strict=True)):
        lo, hi = int(offs[row[i]]), int(offs[row[i] + 1])
        t = [data[p:q].tobytes().decode("utf-8", "ignore") for p, q in ((a, b), (max(lo, a - NEAR), a), (b, min(hi, b + NEAR)))]
        x.append(features(*t, words))
    score = model.margin(np.array(x)) if x else np.zeros(0)
    return row, s - offs[row], e - offs[row], score


@tidy
def scan(docs: DataFrame, model: Trees, words_path: str) -> DataFrame:
    """One row per candidate: where it is, its first characters, the forest's score and the verdict."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_list(words_path)
        for b in batches(it):
            row, s, e, score = found(b.column("text"), model, words)
            data, offs = utf8(b.column("text"))
            preview = [data[offs[r] + x : offs[r] + x + 4].tobytes().decode("ascii", "ignore") for r, x in zip(row, s, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(row, pa.int64())), pa.array(s, pa.int64()), pa.array(e, pa.int64()), pa.array(e - s, pa.int32()), pa.array(preview, pa.utf8()), pa.array(score, pa.float64()), pa.array(score >= model.threshold)], names=[c.split()[0] for c in FINDINGS.split(", ")])

    return stored(texts(docs).mapInArrow(run, FINDINGS), "secrets", keep=True)


@tidy
def redact(docs: DataFrame, model: Trees, words_path: str) -> DataFrame:
    """The documents, all columns kept, with every secret in `text` masked; n_chars, where there is one, is counted anew."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_list(words_path)
        for b in batches(it):
            at = b.schema.get_field_index("text")
            col = b.column(at)
            row, s, e, score = found(col, model, words)
            sure = score >= model.threshold
            if sure.any():
                text = col.to_pylist()
                for r in np.unique(row[sure]):
                    raw, out, done = text[r].encode(), b"", 0
                    for k in np.flatnonzero(sure & (row == r)):
                        out, done = out + raw[done : s[k]] + MASK.encode(), e[k]
                    text[r] = (out + raw[done:]).decode()
                b = b.set_column(at, b.schema.field(at), pa.array(text, col.type))
            yield b

    out = docs.withColumn("text", F.col("text").cast(T.StringType()))
    out = stored(out.mapInArrow(run, out.schema), "redacted", keep=True)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
