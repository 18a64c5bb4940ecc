"""Secrets in texts: candidates by pattern, false positives removed by a random forest.

The forest is trained from labelled findings (candidate, text before, text after, path, label); without any, from
findings that labelled_findings() makes by rule. Features are the candidate's length and make-up, its character
transitions, how much of it dictionary words cover, its path, and the neighbouring words.
Nulls count as empty texts without findings; repeated rows are scanned one by one; an empty table gives an empty
result; other columns are kept by redact() and ignored by scan().
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import trim

#: Findings the forest is trained on at most, trees, depth, and features that a split looks at.
SAMPLE, TREES, DEPTH, TRIED = 6000, 40, 9, 6
NEAR = 48

CANDIDATE = re.compile(
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+?-----END [A-Z ]*PRIVATE KEY-----"
    r"|(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/=-]*[0-9])(?=[0-9_+/=.-]*[A-Za-z])[A-Za-z0-9][A-Za-z0-9_+/=.-]{14,}[A-Za-z0-9=]"
    r"|(?<=[=:]\s[\"'])[^\s\"']{8,}(?=[\"'])|(?<=[=:][\"'])[^\s\"']{8,}(?=[\"'])"
)
# fixed values: words of the dictionary, of secrets' names, and of names of harmless values
WORDS = "about access account action active address admin after agent alpha amount apple array asset author backup base batch before begin beta binary block board body book branch browser buffer build button cache call camera card cell center chain change channel charge chart check child city class clean clear click client close cloud code color column comment common company compile complete config connect console contact container content control copy core count country create current custom data date debug default delete demo deploy design detail device digest direct disk display document domain double download draft driver edit editor element email empty enable engine entry error event example expect export factory false family feature field file filter final find first flag float folder font form format forward frame function future general global graph group guide handle hash header height hello help hidden history home host hour html image import index info init inner input insert install instance integer internal item java join json kernel label language large last layer layout learn left length level library light limit line link list load local lock login logo long loop machine main manage manager market master match media member memory menu message method middle minute mobile mode model module monitor month mouse move name native network next node normal note null number object offer office offset online open option order origin other output owner package page panel param parent parse part patch path pattern payment people person phone photo picture pixel place plan platform player plugin point policy port position post power prefix press preview price primary print private process product profile program project property public query queue quick random range rate read record reference region release remote remove render repeat report request reset resource response rest result return right role root route rule sample save scale schema scope screen script search section select sender server service session setting shadow shape share short simple single size small social sort sound source space spark special stack stage standard start state static status step storage store stream string style submit success suffix super support switch system table target task team template term test text theme thread time title token tool total trace track train tree trigger true type under unique unit update upload user util valid value vector version video view visible visit wait watch week width window word work world write yellow zone".split()
SECRET_WORDS = "token secret passwd password pwd key apikey api_key auth bearer credential private access_key client_secret".split()
HARMLESS_WORDS = "sha sha1 sha256 md5 commit checksum hash digest uuid guid etag revision version build id integrity fingerprint color isbn http https www href url example".split()
PREFIXES = "AKIA ASIA ghp_ gho_ ghs_ github_pat_ glpat- sk_live_ sk-ant- sk- xoxb- xoxp- AIza eyJ SG. npm_ hf_ -----BEGIN".split()
PATHS = "test example fixture sample mock doc lock vendor node_modules".split()

_WORD = re.compile("|".join(sorted(WORDS, key=len, reverse=True)))
_KIND = np.full(128, 4)
for _chars, _k in (("abcdefghijklmnopqrstuvwxyz", 0), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), ("0123456789", 2), ("_-+/=.", 3)):
    _KIND[[ord(c) for c in _chars]] = _k
_UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")


def features(found: str, before: str, after: str, path: str = "") -> list[float]:
    n = len(found)
    code = np.frombuffer(found.encode("ascii", "replace"), np.uint8) & 127
    kind = _KIND[code]
    share = np.bincount(kind, minlength=5) / n
    p = np.bincount(code)[np.unique(code)] / n
    low, left, right, where = found.lower(), before.lower(), after.lower(), (path or "").lower()
    names = set(re.findall(r"[a-z_0-9]+", left[-24:])) | set(re.findall(r"[a-z]+", left[-24:]))
    vowels = sum(c in "aeiou" for c in low)
    return [
        n,
        *share.tolist(),
        float(-(p * np.log2(p)).sum()),
        float((kind[1:] != kind[:-1]).mean()) if n > 1 else 0.0,
        float((np.abs(np.diff(code.astype(int))) <= 1).mean()) if n > 1 else 0.0,
        float(bool(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", found))),
        float(bool(_UUID.match(found))),
        sum(len(w) for w in _WORD.findall(low)) / n,
        vowels / max(1, sum(c.isalpha() for c in low)),
        max(map(len, re.split(r"[^a-zA-Z]+", found)), default=0) / n,
        float(any(found.startswith(x) for x in PREFIXES)),
        float(any(any(s in w for s in SECRET_WORDS) for w in names)),
        float(any(w in HARMLESS_WORDS for w in names) or "://" in left[-12:] or "://" in found),
        float(bool(re.search(r"[=:]\s*[\"']?$", before))),
        float(before[-1:] in ("'", '"') and after[:1] in ("'", '"')),
        float(any(w in right for w in HARMLESS_WORDS)),
        float(any(w in where for w in PATHS)),
        float(found.count(".") + found.count("/") > 2),
        float(bool(re.search(r"(.)\1{4}|x{4}|0123|1234|abcd", low))),
    ]


def labelled_findings(n: int = SAMPLE, seed: int = 11) -> list[tuple[str, str, str, str, int]]:
    """n findings by rule, about half of them secrets: (found, before, after, path, label)."""
    rng = np.random.default_rng(seed)
    pick = lambda chars, k: "".join(rng.choice(list(chars), k))
    lower, upper, digit = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    word = lambda k: [WORDS[i] for i in rng.integers(0, len(WORDS), k)]
    prose = lambda: " ".join(word(4)) + " "
    hexa, alnum = digit + "abcdef", lower + upper + digit
    out = []
    for i in range(n):
        path = str(rng.choice(["", "", "src/app.py", "config/settings.yml", "docs/readme.md", "tests/fixture.json", "package-lock.json"]))
        name = str(rng.choice(SECRET_WORDS)) if rng.random() < 0.7 else "_".join(word(1)) + "_" + str(rng.choice(["token", "key", "secret"]))
        glue = str(rng.choice([' = "', '="', ": '", ": ", "=", " = "]))
        close = '"' if '"' in glue else "'" if "'" in glue else str(rng.choice([" ", "\n"]))
        k = int(rng.integers(0, 8))
        if i % 2:
            value = [lambda: pick(hexa, int(rng.choice([32, 40, 64]))), lambda: "AKIA" + pick(upper + digit, 16), lambda: "ghp_" + pick(alnum, 36), lambda: "sk_live_" + pick(alnum, 24), lambda: pick(alnum + "+/", 40), lambda: pick(alnum, int(rng.integers(20, 48))), lambda: "xoxb-" + pick(digit, 12) + "-" + pick(alnum, 24), lambda: pick(alnum + "!@#%^&*", int(rng.integers(10, 24)))][k]()
            bare = k in (1, 2, 3, 6) and rng.random() < 0.4
            out.append((value, prose() + ("" if bare else name + glue), (" " if bare else close) + prose(), path, 1))
            continue
        harmless = str(rng.choice(HARMLESS_WORDS))
        value, before = [
            lambda: (pick(hexa, int(rng.choice([32, 40, 64]))), harmless + str(rng.choice([": ", " = ", " "]))),
            lambda: ("-".join(pick(hexa, m) for m in (8, 4, 4, 4, 12)), str(rng.choice(["id = \"", "uuid: ", ""]))),
            lambda: ("/".join(word(4)) + str(rng.integers(0, 99)), str(rng.choice(["path: ", "https://", ""]))),
            lambda: ("_".join(word(3)) + str(rng.integers(0, 99)), str(rng.choice(["name = \"", "", "def "]))),
            lambda: ("".join(w.capitalize() for w in word(4)) + str(rng.integers(0, 9)), ""),
            lambda: (str(rng.choice(["your", "example", "changeme", "insert", "dummy"])) + "_" + "_".join(word(2)) + "_" + str(rng.integers(1, 9)), name + glue),
            lambda: ("x" * int(rng.integers(12, 32)) + str(rng.integers(0, 99)), name + glue),
            lambda: (pick(lower, int(rng.integers(8, 14))) + str(rng.integers(1, 31)) + "." + pick(lower, 6) + "-" + pick(digit, 4), ""),
        ][k]()
        out.append((value, prose() + before, ('"' if before.endswith('"') else close) + prose(), path, 0))
    return out


@dataclass
class Forest:
    """Trees as arrays: feature (or -1), threshold, left child (the right one follows), share of secrets."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for f, t, child, share in self.trees:
            at = np.zeros(len(x), int)
            for _ in range(DEPTH):
                inner = f[at] >= 0
                if not inner.any():
                    break
                go = x[np.arange(len(x)), np.maximum(f[at], 0)] > t[at]
                at = np.where(inner, child[at] + go, at)
            out += share[at]
        return out / max(1, len(self.trees))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 5) -> Forest:
    """A forest of bootstrapped trees, each split the best Gini gain among a few features' quantiles."""
    rng, out = np.random.default_rng(seed), []
    for _ in range(trees):
        f, t, child, share = [-1], [0.0], [0], [0.0]
        todo = [(0, rng.integers(0, len(x), len(x)), 0)]
        while todo:
            node, rows, d = todo.pop()
            s = y[rows].mean()
            share[node] = s
            if d >= depth or s in (0, 1) or len(rows) < 8:
                continue
            best = (2 * s * (1 - s) - 1e-9, -1, 0.0)
            for j in rng.choice(x.shape[1], min(TRIED, x.shape[1]), replace=False):
                v = x[rows, j]
                for q in np.unique(np.quantile(v, np.linspace(0.05, 0.95, 13))):
                    m = v > q
                    a = m.mean()
                    if 0 < a < 1:
                        r, l = y[rows[m]].mean(), y[rows[~m]].mean()
                        best = min(best, (a * 2 * r * (1 - r) + (1 - a) * 2 * l * (1 - l), int(j), float(q)))
            if best[1] >= 0:
                m = x[rows, best[1]] > best[2]
                f[node], t[node], child[node] = best[1], best[2], len(f)
                f += [-1, -1]
                t += [0.0, 0.0]
                child += [0, 0]
                share += [0.0, 0.0]
                todo += [(child[node], rows[~m], d + 1), (child[node] + 1, rows[m], d + 1)]
        out.append((np.array(f), np.array(t), np.array(child), np.array(share)))
    return Forest(out)


def trained(findings: list[tuple[str, str, str, str, int]] | None = None) -> Forest:
    """A forest from labelled findings, of which SAMPLE are used at most."""
    findings = (findings or labelled_findings())[:SAMPLE]
    x = np.array([features(*r[:4]) for r in findings])
    return grow(x, np.array([r[4] for r in findings], float))


def find(text: str, path: str, forest: Forest) -> tuple[list[re.Match], np.ndarray]:
    hits = list(CANDIDATE.finditer(text))
    if not hits:
        return hits, np.zeros(0)
    x = np.array([features(m.group(), text[max(0, m.start() - NEAR) : m.start()], text[m.end() : m.end() + NEAR], path) for m in hits])
    return hits, forest.score(x)


_ITEM = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("secret", pa.bool_())])


def scan(docs: DataFrame, forest: Forest, path: str | None = None, least: float = 0.5) -> DataFrame:
    """(doc_id, text, findings, redacted): every candidate's place in characters, its score, and whether it is a secret;
    redacted is the text with secrets replaced. path names a column that holds where a text is from."""

    def run(batches):
        trim()
        for b in batches:
            found, clean = [], []
            for t, w in zip(b.column(1), b.column(2), strict=True):
                text = t.as_py()
                hits, scores = find(text or "", w.as_py() or "", forest)
                found.append([{"start": m.start(), "end": m.end(), "score": float(s), "secret": bool(s >= least)} for m, s in zip(hits, scores, strict=True)])
                at, parts = 0, []
                for m, s in zip(hits, scores, strict=True):
                    if s >= least:
                        parts += [text[at : m.start()], "<secret>"]
                        at = m.end()
                clean.append(text if not parts else "".join([*parts, text[at:]]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.list_(_ITEM)), pa.array(clean, pa.string())], names=["doc_id", "text", "findings", "redacted"])

    where = F.col(path).cast("string") if path else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), where.alias("path"))
    return rows.mapInArrow(run, "doc_id long, text string, findings array<struct<start:int,end:int,score:double,secret:boolean>>, redacted string")


def redact(docs: DataFrame, forest: Forest, text: str = "text", least: float = 0.5) -> DataFrame:
    """docs, all columns and rows, with secrets in the text column replaced; a length column n_chars follows."""

    def run(batches):
        trim()
        for b in batches:
            clean = []
            for t in b.column(text):
                t = t.as_py()
                hits, scores = find(t or "", "", forest)
                at, parts = 0, []
                for m, s in zip(hits, scores, strict=True):
                    if s >= least:
                        parts += [t[at : m.start()], "<secret>"]
                        at = m.end()
                clean.append(t if not parts else "".join([*parts, t[at:]]))
            yield b.set_column(b.schema.get_field_index(text), text, pa.array(clean, b.schema.field(text).type))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
