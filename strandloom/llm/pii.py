"""Personal data: fixed patterns, and weak supervision for spans beyond them.

Four kinds have fixed patterns, whose matches always count, and looser ones. Account numbers
(IBAN) and secrets (keys, tokens, passwords in clear) have looser patterns only. Labelers
by shape, check, gazetteer and context vote on every candidate; expectation-maximisation
estimates how reliable each of them is for each kind, and a classifier learns from its
posteriors which spans to accept.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
#: All kinds, in the order of spans.
ALL = (*KINDS, "iban", "secret")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# no digit before: a failed run of digits is not tried again from its middle, which could not match either
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
Span = tuple[int, int]


def emails(text: str) -> list[Span]:
    """Leftmost matches of the e-mail pattern, found from each @ so that long runs cost once."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            out.append((start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def luhn(digits: str) -> bool:
    total = sum(int(c) for c in digits[-1::-2]) + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(c)] for c in digits[-2::-2])
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _small(part: str) -> bool:
    p = part.lstrip("0")
    return len(p) < 3 or len(p) == 3 and int(p) <= 255


def base_spans(text: str) -> dict[str, list[Span]]:
    """Spans of the fixed patterns by kind; matches that fail their test are dropped, not retried."""
    out: dict[str, list[Span]] = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = emails(text)
    if _DIGIT.search(text):
        out["ip"] = [m.span() for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out["card"].append(m.span())
        if "+" in text:
            out["phone"] = [m.span() for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


# --- candidates beyond the patterns, labelers and features -------------------------------------

_LOOSE = {
    "email": re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}(?:\x20?[\[({]\x20?(?:at|AT|@)\x20?[\])}]\x20?|\x20(?:at|AT)\x20|\x20@\x20)[A-Za-z0-9-]{1,63}(?:(?:\.|\x20?[\[({]\x20?(?:dot|DOT|\.)\x20?[\])}]\x20?|\x20(?:dot|DOT)\x20)[A-Za-z0-9-]{1,63}){1,5}"),
    "ip": re.compile(r"(?<![0-9A-Za-z.:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])|(?<![0-9.])(?:[0-9]{1,3}\x20?[\[({]\.[\])}]\x20?){3}[0-9]{1,3}(?![0-9.])"),
    "card": re.compile(r"(?<![0-9])(?:[0-9]{4}[\x20._/-]{1,2}){3}[0-9]{1,7}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9+(])(?:00[1-9][0-9]{0,2}[\x20.-]?)?(?:1[\x20.-])?\(?[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "secret": re.compile(r"(?<![A-Za-z0-9_/+=.-])(?:[A-Za-z0-9_/+=-]{20,512}|(?<=[=:\"'\x20])(?=[^\s\"',;]*[0-9])(?=[^\s\"',;]*[A-Za-z])(?=[^\s\"',;]*[!@#$%^&*?])[A-Za-z0-9!@#$%^&*?_+-]{8,64})(?![A-Za-z0-9_/+=-])"),
}
# Gazetteers of endings, issuers' first digits, and words around personal data.
_ENDINGS = frozenset("com org net edu gov int info biz io dev app de fr es it uk us ca au eu ch at nl be".split())
_ISSUERS = ("34", "35", "36", "37", "38", "4", "51", "52", "53", "54", "55", "60", "62", "65")
_COUNTRIES = frozenset("AD AE AL AT AZ BA BE BG BH BR BY CH CR CY CZ DE DK DO EE EG ES FI FO FR GB GE GI GL GR GT HR HU IE IL IQ IS IT JO KW KZ LB LC LI LT LU LV MC MD ME MK MR MT MU NL NO PK PL PS PT QA RO RS SA SC SE SI SK SM ST SV TL TN TR UA VA VG XK".split())
_SECRETS = ("AKIA", "ASIA", "AIza", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "sk_live_", "sk_test_", "sk-", "rk_live_", "xoxb-", "xoxp-", "eyJ", "SG.", "npm_", "pypi-")
_NEAR = {
    "email": frozenset("mail email e-mail contact write reach address courriel correo kontakt".split()),
    "ip": frozenset("ip address host server client login from ipv6 adresse".split()),
    "card": frozenset("card visa credit debit mastercard amex payment carte tarjeta karte kreditkarte".split()),
    "phone": frozenset("phone tel telephone call mobile cell fax whatsapp téléphone teléfono telefon handy".split()),
    "iban": frozenset("iban account bank transfer konto compte cuenta bic swift".split()),
    "secret": frozenset("key apikey api_key token secret password passwd pwd auth bearer credential credentials access_token".split()),
}
_AWAY = frozenset("version release isbn issn order invoice ticket ref id no number build section figure table serial sku part".split())
_WORD = re.compile(r"[^\W\d_][\w-]*")
LABELERS = ("shape", "check", "gazetteer", "context", "counter")


_AT = (" at ", " AT ", *(b + s + w for b in "[({" for s in ("", " ") for w in ("at", "AT")))


def _written(text: str) -> bool:
    """Whether one of the forms of @ is there that the loose e-mail pattern needs."""
    return "@" in text or any(x in text for x in _AT)


def _likely(text: str) -> bool:
    """False only where no pattern can match: each has a digit, a form of @, or the seven colons of an address in hex letters."""
    return bool(_DIGIT.search(text)) or text.count(":") >= 7 or _written(text)


def candidates(text: str) -> Iterator[tuple[str, int, int, tuple[int, ...], tuple[int, ...]]]:
    """(kind, start, end, votes, features) of base spans and of looser matches that overlap none."""
    if not _likely(text):
        return
    base = base_spans(text)
    taken = sorted(s for v in base.values() for s in v)
    digits = bool(_DIGIT.search(text))
    for kind in KINDS:
        for s, e in base[kind]:
            yield kind, s, e, *judge(kind, text, s, e, True)
        if kind != "email" and not digits and not (kind == "ip" and text.count(":") >= 7):
            continue
        if kind == "email" and not _written(text):
            continue
        for m in _LOOSE[kind].finditer(text):
            s, e = m.span()
            if not any(a < e and s < b for a, b in taken):
                yield kind, s, e, *judge(kind, text, s, e, False)
    for kind in ALL[len(KINDS) :] if digits else ():
        for m in _LOOSE[kind].finditer(text):
            s, e = m.span()
            if (kind == "iban" or mixed(m[0])) and not any(a < e and s < b for a, b in taken):
                yield kind, s, e, *judge(kind, text, s, e, False)


def mixed(span: str) -> bool:
    """Letters and digits, and no word of the language: at least a quarter of the characters are digits, capitals or marks."""
    other = sum(not c.islower() for c in span)
    return any(c.isdigit() for c in span) and any(c.isalpha() for c in span) and 4 * other >= len(span)


def entropy(span: str) -> float:
    """Bits per character, by the characters' shares in the span."""
    share = np.array(list(Counter(span).values())) / len(span)
    return float(-(share * np.log2(share)).sum())


def mod97(span: str) -> bool:
    """The check of ISO 13616."""
    x = span.replace(" ", "")
    return 15 <= len(x) <= 34 and int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


def judge(kind: str, text: str, s: int, e: int, strict: bool) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """Votes of LABELERS (1 personal, -1 not, 0 no opinion) and small integer features."""
    span, d = text[s:e], _digits(text[s:e])
    if kind == "email":
        check = 1 if strict or re.search(r"[\[({]", span) else 0
        gazetteer = 1 if re.split(r"[^A-Za-z0-9]+", span.strip(")]}"))[-1].lower() in _ENDINGS else -1
    elif kind == "ip":
        check = 1 if strict or ":" in span else 0
        gazetteer = -1 if strict and span.split(".")[0].lstrip("0") in ("", "255") else 1 if strict else 0
    elif kind == "card":
        check = 1 if 13 <= len(d) <= 19 and luhn(d) else -1
        gazetteer = 1 if d.startswith(_ISSUERS) else -1
    elif kind == "iban":
        check = 1 if mod97(span) else -1
        gazetteer = 1 if span[:2] in _COUNTRIES else -1
    elif kind == "secret":
        check = 1 if entropy(span) >= 3 else -1
        gazetteer = 1 if span.startswith(_SECRETS) or len(span) in (32, 40, 64) and all(c in "0123456789abcdefABCDEF" for c in span) else 0
    else:
        check = 1 if 9 <= len(d) <= 15 else -1
        gazetteer = 1 if not strict and d[-10:-9] not in ("", "0", "1") and d[-7:-6] not in ("0", "1") else 0
    before = [w.lower() for w in _WORD.findall(text[max(0, s - 60) : s])][-5:]
    after = [w.lower() for w in _WORD.findall(text[e : e + 40])][:2]
    near = bool(_NEAR[kind] & {*before, *after})
    away = bool(_AWAY & set(before[-2:]))
    joined = s > 0 and (text[s - 1].isalnum() or text[s - 1] in "_#$") or e < len(text) and (text[e].isalnum() or text[e] == "_")
    votes = (1 if strict else -1 if joined else 0, check, gazetteer, 1 if near else 0, -1 if away or joined else 0)
    separators = {c for c in span if not c.isalnum()}
    return votes, (int(strict), int(near), int(away), int(joined), min(len(separators), 3), check + 1, gazetteer + 1)


# --- the label model and the classifier ---------------------------------------------------------


def expectation_maximisation(votes: np.ndarray, weight: np.ndarray, rounds: int = 50) -> np.ndarray:
    """P(personal) of each pattern of votes, from a model with one reliability table per labeler.

    votes: patterns x labelers in -1, 0, 1; weight: how often each pattern occurs in the
    whole corpus. Starts from the majority and ends when no posterior moves by 1e-6.
    """
    n, m = votes.shape
    p = 1 / (1 + np.exp(-1.5 * votes.sum(1)))
    for _ in range(rounds):
        prior = (weight @ p + 1) / (weight.sum() + 2)
        logit = np.full(n, np.log(prior / (1 - prior)))
        for j in range(m):
            for v in (-1, 0, 1):
                at = votes[:, j] == v
                # a labeler is taken to be better than chance: a tenth of a vote towards its side
                yes = (weight[at] @ p[at] + 1 + 0.1 * (v > 0)) / (weight @ p + 3)
                no = (weight[at] @ (1 - p[at]) + 1 + 0.1 * (v < 0)) / (weight @ (1 - p) + 3)
                logit[at] += np.log(yes / no)
        new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        moved = np.abs(new - p).max()
        p = new
        if moved < 1e-6:
            break
    return p


def _vector(kind: int, features: tuple[int, ...]) -> np.ndarray:
    """One-hot features, each also crossed with the kind."""
    k = len(ALL)
    x = np.zeros(1 + k + 7 * (k + 1) * 4)
    x[0] = 1
    x[1 + kind] = 1
    for j, v in enumerate(features):
        x[1 + k + (j * (k + 1) + kind) * 4 + v] = 1
        x[1 + k + (j * (k + 1) + k) * 4 + v] = 1
    return x


class Model(dict):
    """P(personal) by (kind, features), and the weights that give it for combinations not seen in fitting."""

    weights: np.ndarray | None = None

    def probability(self, kind: int, features: tuple[int, ...]) -> float:
        key = (kind, features)
        if key not in self:
            if self.weights is None:
                return 0.0
            self[key] = float(1 / (1 + np.exp(-_vector(kind, features) @ self.weights)))
        return self[key]


def train(counts: Counter) -> Model:
    """P(personal) for every (kind, features) that occurs, by logistic regression on EM's posteriors.

    The weights stay in the model; without any candidate there are none, and nothing is accepted.

    counts: occurrences of (kind, votes, features) in the whole corpus; features and votes
    take few values, so this is every candidate of the corpus, not a sample of them.
    """
    keys = sorted(counts)
    model = Model()
    if not keys:
        return model
    weight = np.array([counts[k] for k in keys], float)
    target = np.zeros(len(keys))
    for kind in range(len(ALL)):
        mine = np.array([i for i, k in enumerate(keys) if k[0] == kind], int)
        if len(mine):
            target[mine] = expectation_maximisation(np.array([keys[i][1] for i in mine]), weight[mine])
    x = np.array([_vector(k[0], k[2]) for k in keys])
    scale = np.sqrt(weight)  # so that a frequent pattern does not silence the rare ones
    scale /= scale.sum()
    w = np.zeros(x.shape[1])
    for _ in range(400):
        p = 1 / (1 + np.exp(-x @ w))
        grad = x.T @ (scale * (p - target)) + 1e-3 * w
        h = (x * (scale * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        step = np.linalg.solve(h, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    model.weights = w
    for k in keys:
        model.probability(k[0], k[2])
    return model


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for b in batches:
        for t in common.texts(b, "t"):
            for kind, _, _, votes, features in candidates(t):
                counts[ALL.index(kind), votes, features] += 1
    keys = list(counts)
    small = pa.list_(pa.int32())
    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], small), pa.array([k[2] for k in keys], small), pa.array([counts[k] for k in keys], pa.int64())], ["kind", "votes", "features", "n"])


def fit(docs: DataFrame, text_col: str = "text") -> Model:
    """Count the patterns of votes and features over every text, and train on the counts.

    What comes to the driver is one row per pattern that occurs: at most 6 kinds
    x 3^5 votes x the values of 7 small features, whatever the corpus.
    """
    common.prepare(docs.sparkSession)
    rows = docs.select(docs[f"`{text_col}`"].alias("t")).mapInArrow(_tally, "kind int, votes array<int>, features array<int>, n long").groupBy("kind", "votes", "features").agg(F.sum("n").alias("n"))
    return train(Counter({(r["kind"], tuple(r["votes"]), tuple(r["features"])): r["n"] for r in rows.collect()}))


def added_spans(text: str, model: Model, cut: float = 0.5) -> list[tuple[str, int, int]]:
    out = []
    for kind, s, e, _, features in candidates(text):
        if not features[0] and model.probability(ALL.index(kind), features) >= cut:
            out.append((kind, s, e))
    return out


def find_personal_data(docs: DataFrame, model: Model, cut: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, spans): spans as kind:start:end in code points, by kind and then start.

    `base` holds the matches of the fixed patterns, `spans` those and the
    candidates that the classifier accepts; base spans always stay. Null and
    empty texts have none; every row is judged alone, so repeated rows agree;
    an empty table gives no rows. Each pattern runs in time linear in the text.
    """
    spark = common.prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, every = [], []
            for t in common.texts(b, "t"):
                found = [(k, *s) for k, v in base_spans(t).items() for s in v] if _likely(t) else []
                more = sorted([*found, *added_spans(t, shared.value, cut)], key=lambda x: (ALL.index(x[0]), x[1], x[2])) if _likely(t) else []
                base.append([f"{k}:{s}:{e}" for k, s, e in found])
                every.append([f"{k}:{s}:{e}" for k, s, e in more])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(base, pa.list_(pa.string())), pa.array(every, pa.list_(pa.string()))], ["i", "base", "spans"])

    source = docs.select(common.ids(docs, id_col).alias("i"), docs[f"`{text_col}`"].alias("t"))
    return source.mapInArrow(run, "i long, base array<string>, spans array<string>").withColumnRenamed("i", id_col)


def digest(found: DataFrame) -> DataFrame:
    """Numbers of base spans by kind, their sha256, and all spans joined by commas."""

    def count(kind: str):
        return F.size(F.filter("base", lambda x: x.startswith(kind + ":"))).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS), F.sha2(F.concat_ws(",", "base"), 256).alias("base_sha256"), F.concat_ws(",", "spans").alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_added"))


def brute_force(text: str | None) -> list[tuple[str, int, int]]:
    """Base spans by the plain patterns, for tests."""
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        doubled = [int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))]
        if 13 <= len(d) <= 19 and sum(doubled) % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out
