"""Operator 9: personal data by patterns and a skip-chain conditional random field.

Base: patterns for emails, ip addresses, card and phone numbers over the whole text. On top, a
field labels the other mentions of a document (tokens with an at sign or four digits or more, and
repeats of an email's local part). Mentions that stand side by side share a chain potential;
mentions that are equal, or agree in their last seven digits or their local part, share a skip
potential with the mention before them that does, however far away. Labels of base spans are
given; those of the others come from loopy message passing, which carries a label found in one
place to the document's other mentions of it. What is labelled with enough certainty is a span
too; base spans stay as they are.

The weights are trained by train() on a bounded sample, labelled by the base patterns, with
features of a mention hidden at random, so that the weights of the links are learnt as well. The
numbers in pii_weights.json come from it.

Defined cases: a null text counts as empty; spans are in code points, end exclusive; rows are
looked at one by one, so that repeated rows get the same result; an empty table gives an empty
result; other columns are not read. A text is read once by each pattern and once for its mentions,
and a mention links to the one before it only: the work is linear in a text's length.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

ship(__name__)

KINDS = ("email", "ip", "card", "phone")
CERTAIN = 0.9
ROUNDS = 8
N_FEATURES = 14
LINKS = ("chain", "equal", "similar")
TRAIN_DOCS = 2000

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can begin at the first digit of a run only, and takes runs as a whole: what fails there
# fails at every later digit of the run as well. So each run is read once.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_OTHERS = re.compile(r"[^0-9]+")
_MENTION = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = "()[]{}<>,;:!?\"'.|"
_NAME = re.compile(r"[A-Za-z0-9._%+-]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        if k % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def octets(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in text.split("."))


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of the email pattern, looked for around at signs only: a local part can't hold one,
    so it begins at the far end of the characters before it, or after the match before."""
    out, low = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        m = _EMAIL.match(text, start) if start < at else None
        if m:
            out.append(m.span())
            low = m.end()
        at = text.find("@", m.end() if m else at + 1)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted; kinds are numbered as in KINDS."""
    out = [(s, 0, e) for s, e in emails(text)]
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if octets(m.group())]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            d = _OTHERS.sub("", m.group())
            if 14 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= len(_OTHERS.sub("", m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def features(core: str, digits: str, before: str) -> list[float]:
    n, at = len(digits), core.find("@")
    letters = any(ch.isalpha() for ch in core)
    dotted = core.count(".") == 3 and not letters and core.replace(".", "").isdigit()
    return [
        1.0,
        float(at >= 0),
        float(at > 0 and "." in core[at:]),
        float(core[:1] == "+"),
        float(14 <= n <= 19 and not letters),
        float(14 <= n <= 19 and not letters and luhn(digits)),
        float(dotted and octets(core)),
        float(10 <= n <= 13 and not letters and not dotted),
        float(n == 7 and not letters),
        float(n < 7 and not letters),
        float(letters and n >= 4),
        float("=" in core or '"' in core),
        float(before.endswith(")") or before[:1] == "+"),
        float(at < 0 and letters and n < 4),
    ]


class Graph:
    """The mentions of a text: spans, features, given labels (-1: open), links (u, v, kind)."""

    def __init__(self, text: str, base: list[tuple[int, int, int]]):
        self.spans, self.features, self.given, self.links = [], [], [], []
        found = []
        before = ""
        locals_ = {text[s : text.index("@", s)].lower() for s, k, _ in base if k == 0}
        locals_ = {x for x in locals_ if len(x) >= 5}
        for m in _MENTION.finditer(text):
            t = m.group()
            core = ""
            if "@" in t or sum(map(str.isdigit, t)) >= 4:
                core = t.strip(_EDGE)
                if core:
                    s = m.start() + t.index(core)
                    found.append((s, s + len(core), core, before))
            if locals_ and not core:
                for x in _NAME.finditer(t):
                    name = x.group().rstrip(".-")
                    if name.lower() in locals_:
                        s = m.start() + x.start()
                        found.append((s, s + len(name), name, ""))
            before = t
        last: dict[tuple, int] = {}
        b = 0
        for s, e, core, before in found:
            k = len(self.spans)
            while b < len(base) and base[b][2] <= s:
                b += 1
            given = next((kind + 1 for x, kind, y in base[b : b + 4] if x < e and y > s), -1)
            digits = "".join(ch for ch in core if "0" <= ch <= "9")
            self.spans.append((s, e))
            self.features.append(features(core, digits, before))
            self.given.append(given)
            if k and self.spans[k - 1][1] <= s <= self.spans[k - 1][1] + 3:
                self.links.append((k - 1, k, 0))
            whole = ("w", core.lower())
            tail = ("d", digits[-7:]) if len(digits) >= 7 and "@" not in core else ("l", core.lower().split("@")[0])
            if whole in last:
                self.links.append((last[whole], k, 1))
            elif tail in last:
                self.links.append((last[tail], k, 2))
            last[whole] = last[tail] = k


def beliefs(unary: np.ndarray, links: list, pair: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Label probabilities by loopy message passing; unary holds log potentials."""
    if links:
        u, v, kind = (np.array(x) for x in zip(*links, strict=True))
        source, goal, kinds = np.concatenate([u, v]), np.concatenate([v, u]), np.concatenate([kind, kind])
        back = np.concatenate([np.arange(len(u)) + len(u), np.arange(len(u))])
        potential = pair[kinds]
        sent = np.zeros((len(source), unary.shape[1]))
        for _ in range(rounds):
            at = unary.copy()
            np.add.at(at, goal, sent)
            x = (at[source] - sent[back])[:, :, None] + potential
            top = x.max(axis=1, keepdims=True)
            new = np.log(np.exp(x - top).sum(axis=1)) + top[:, 0]
            new -= new.max(axis=1, keepdims=True)
            sent = 0.5 * sent + 0.5 * new
        unary = unary.copy()
        np.add.at(unary, goal, sent)
    p = np.exp(unary - unary.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def added_spans(text: str, base: list, weights: dict) -> list[tuple[int, int, int]]:
    """Spans that the field finds beyond the base, apart from all base spans."""
    g = Graph(text, base)
    if -1 not in g.given:
        return []
    unary = np.array(g.features) @ weights["unary"].T
    for k, label in enumerate(g.given):
        if label >= 0:
            unary[k] = -30.0
            unary[k, label] = 30.0
    p = beliefs(unary, g.links, weights["pair"])
    best = p.argmax(axis=1)
    return [(g.spans[k][0], int(best[k]) - 1, g.spans[k][1]) for k in range(len(best)) if g.given[k] < 0 and best[k] and p[k, best[k]] >= CERTAIN]


def spelled(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def load_weights(path: str | None = None) -> dict:
    data = json.loads(Path(path or Path(__file__).with_name("pii_weights.json")).read_text())
    return {k: np.array(data[k]) for k in ("unary", "pair")}


def _mentioned_again(text: str, base: list, rng: np.random.Generator) -> tuple[str, int]:
    """A line that mentions a base span of the text once more, not always in full, with its label;
    for a text without one, a number that is no one's."""
    if not base:
        return "".join(map(str, rng.integers(0, 10, rng.integers(4, 14)))), 0
    s, kind, e = base[rng.integers(len(base))]
    span, digits = text[s:e], _OTHERS.sub("", text[s:e])
    if kind == 0:
        return [span.upper(), span.split("@")[0], span][rng.integers(3)], 1
    if kind == 3:
        return [digits[-10:], digits[-7:], f"{digits[-7:-4]}-{digits[-4:]}"][rng.integers(3)], 4
    return [span, digits if kind == 2 else span][rng.integers(2)], kind + 1


def train(texts: list[str], *, rounds: int = 400, hide: float = 0.3, rate: float = 0.2, decay: float = 1e-3, seed: int = 5) -> dict:
    """Weights by pseudo-likelihood on TRAIN_DOCS texts at most, labelled by the base patterns."""
    x, y, ends, kinds, others = [], [], [], [], []
    rng = np.random.Generator(np.random.PCG64(seed))
    for text in texts[:TRAIN_DOCS]:
        text = text or ""
        base = base_spans(text)
        again, label = _mentioned_again(text, base, rng)
        g = Graph(f"{text}\n{again}", base)
        low = len(x)
        x += g.features
        y += [max(0, k) if s <= len(text) else label for k, (s, _) in zip(g.given, g.spans, strict=True)]
        for u, v, kind in g.links:
            ends += [low + u, low + v]
            others += [low + v, low + u]
            kinds += [kind, kind]
    f, y = np.array(x, dtype=float).reshape(-1, N_FEATURES), np.array(y, dtype=int)
    ends, others, kinds = (np.array(z, dtype=int) for z in (ends, others, kinds))
    n, m = len(KINDS) + 1, len(LINKS)
    unary, pair = np.zeros((n, N_FEATURES)), np.zeros((m, n, n))
    goal = np.eye(n)[y]
    for _ in range(rounds):
        shown = f * np.where(rng.random((len(f), 1)) < hide, np.eye(1, N_FEATURES), 1.0)
        logits = shown @ unary.T
        np.add.at(logits, ends, pair[kinds, y[others]])
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        err = (p / p.sum(axis=1, keepdims=True) - goal) / max(1, len(f))
        step = np.zeros_like(pair)
        np.add.at(step, (kinds, y[others]), err[ends])
        unary -= rate * 20 * (err.T @ shown + decay * unary / n)
        step = step + step.transpose(0, 2, 1)
        pair -= rate * 20 * (step + decay * pair / n)
    return {"unary": unary, "pair": pair}


def _finder(weights: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                counts, shas, every = [[] for _ in KINDS], [], []
                for value in part.column(1):
                    text = value.as_py() or ""
                    base = base_spans(text)
                    for k, out in enumerate(counts):
                        out.append(sum(x[1] == k for x in base))
                    line = spelled(base)
                    shas.append(hashlib.sha256(line.encode()).hexdigest())
                    more = added_spans(text, base, weights)
                    every.append(spelled(sorted(base + more)) if more else line)
                columns = [part.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(shas, pa.string()), pa.array(every, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return run


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", weights: dict | None = None) -> DataFrame:
    """A row for each document: id, n_email, n_ip, n_card, n_phone (base), base_sha256, spans."""
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, " + ", ".join(f"n_{k} bigint" for k in KINDS) + ", base_sha256 string, spans string"
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_finder(weights or load_weights()), schema).withColumnRenamed("id", id_col)


def redact(text: str, spans: str) -> str:
    """The text with each span replaced by its kind in brackets; of spans that overlap the first stays."""
    out, at = [], 0
    for one in filter(None, spans.split(",")):
        kind, s, e = one.split(":")
        if int(s) >= at:
            out += [text[at : int(s)], f"[{kind}]"]
            at = int(e)
    return "".join([*out, text[at:]])
