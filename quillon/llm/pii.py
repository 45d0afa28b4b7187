"""Personal data by weak supervision.

Four kinds have fixed patterns and are always reported. Further candidates are
tokens with a digit, values that a sensitive word assigns, names and street
addresses. Pattern, gazetteer and context labelers vote for or against each or
abstain; expectation maximisation over all documents estimates how reliable each
labeler is, and a span classifier learns from the resulting probabilities.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import named, written

#: Fixed by the contract, in this order; then what the method adds.
BASE = ("email", "ip", "card", "phone")
ADDED = ("secret", "number", "name", "address")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match of the plain pattern can only begin where a run of digits does; saying so keeps long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each @: everything before it that may stand there belongs to the match."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > free and text[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(text, at + 1) if a < at else None
        if m:
            out.append((a, m.end()))
            free = m.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(free, at + 1))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """All spans of the fixed kinds, by kind, then start. Matches that fail their test are dropped, not retried."""
    found = [("email", a, b) for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
            found.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if len(digits) <= 19 and len(digits) >= 13 and luhn(digits):
                found.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                found.append(("phone", m.start(), m.end()))
    return found


#: Shapes of candidates. A code ends at white space, quotes, brackets and signs that assign or part, and has a digit.
CODE, ASSIGNED, NAME, ADDRESS = range(4)
_FROM_DIGIT = re.compile(r"[0-9][^\s\"'=:,;|<>()\[\]{}]*+")
_ENDS = re.compile(r"[\s\"'=:,;|<>()\[\]{}]")
_TRIM = ".!?#$%&*"
_VALUE = re.compile(r"(?:[Pp]ass(?:word|wd|phrase|code)|[Pp]wd|[Ss]ecret|[Tt]oken|[Aa]pi[_ -]?[Kk]ey|PASSWORD|SECRET|TOKEN|API_KEY)[\"']?\s{0,2}(?:[=:]|is)\s{0,2}[\"']?([^\s\"'=:,;|<>()\[\]{}]{4,})")
_VALUE_HINTS = ("pass", "pwd", "secret", "token", "api")
_CAPITAL = "A-ZÀ-ÖØ-ÞΑ-ΩА-Я"
_CAPITALS = re.compile(rf"[{_CAPITAL}][^\W\d_]*+(?:\.?[ ][{_CAPITAL}][^\W\d_]*+){{1,3}}")

#: Words that people use as titles, names, kinds of street, and around them.
_TITLES = frozenset("Mr Mrs Ms Miss Mx Dr Prof Sir Dame Madam Herr Frau Monsieur Madame Mme Mlle Señor Señora Don Doña Sr Sra".split())
_GIVEN = frozenset(
    """James Mary John Peter Maria Patricia Robert Jennifer Michael Linda William Elizabeth David Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen
    Christopher Nancy Daniel Lisa Matthew Betty Anthony Margaret Mark Sandra Donald Ashley Steven Kimberly Paul Emily Andrew Donna Joshua Michelle
    Kenneth Carol Kevin Amanda Brian Dorothy George Melissa Edward Deborah Ronald Stephanie Timothy Rebecca Jason Sharon Jeffrey Laura Ryan Cynthia
    Jacob Kathleen Gary Amy Nicholas Angela Eric Shirley Jonathan Anna Stephen Brenda Larry Pamela Justin Emma Scott Nicole Brandon Helen
    Hans Klaus Wolfgang Jürgen Dieter Uwe Stefan Andreas Ursula Monika Petra Sabine Renate Heike Jean Pierre Michel Philippe Alain Marie Nathalie
    Isabelle Sylvie Françoise José Antonio Manuel Francisco Juan Javier Carmen María Josefa Isabel Pilar Lucía Sofia Giulia Marco Luca Mohammed Ahmed Ali
    Fatima Aisha Omar Yusuf Wei Li Ming Yuki Hiroshi Kenji Priya Raj Anil Sunita Ivan Olga Dmitri Natalia Piotr Agnieszka""".split()
)
_STREET = "Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Dr|Court|Ct|Boulevard|Blvd|Square|Sq|Terrace|Place|Pl|Way|Close|Crescent|Parkway|Highway|Row|Mews"
_NOT_NAMES = frozenset(
    """University College School Church Company Corporation Inc Ltd Group Bank Party River Lake Mount Island City County State Street Road Avenue Park Museum Hotel Hospital
    Center Centre Award Prize War Act Bay House Press Committee Association Institute January February March April May June July August September October
    November December Monday Tuesday Wednesday Thursday Friday Saturday Sunday""".split()
)
#: A house number before the street; a street's last part, or its first, that shows where to look.
_NUMBER_STREET = re.compile(rf"[0-9]{{1,5}}[A-Za-z]?,?\s(?:(?:[{_CAPITAL}][\w'.-]*\s){{1,3}}(?:{_STREET})\b|(?:rue|avenue|boulevard|place)\s(?:d[eu]\s|des\s|de\sla\s)?[{_CAPITAL}]\w*)")
_STREET_NUMBER = re.compile(r"(?:straße|strasse|gasse|allee|platz|weg)\s[0-9]{1,4}[a-z]?(?!\w)")
_CALLE_NUMBER = re.compile(rf"(?:[Cc]alle|[Aa]venida|[Pp]laza|[Pp]aseo)\s(?:de\s|del\s|de\sla\s)?[{_CAPITAL}]\w*,?\s[0-9]{{1,4}}(?!\w)")
_CALLE_HINTS = ("alle ", "venida ", "laza ", "aseo ")
_WORD_START = re.compile(rf"[{_CAPITAL}]\w*$")
_HEX = re.compile(r"[0-9a-fA-F]{16,}")
_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_KEY = re.compile(r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_\w{30,}|[sp]k_(?:live|test)_\w{16,}|xox[abprs]-[\w-]{10,}|eyJ[\w-]{10,}(?:\.[\w-]+)*|(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9])[A-Za-z0-9+/_-]{20,}={0,2}")
_ACCOUNT = re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}|[0-9]{3}-[0-9]{2}-[0-9]{4}|00[1-9][0-9]{8,13}")
_PLAIN = re.compile(r"[0-9]{1,5}|[0-9]{13,19}|[0-9]{1,4}(?:[-/.][0-9]{1,4}){2}|v?[0-9]+(?:\.[0-9]+)+|[0-9]{1,3}(?:[.,][0-9]{3})+|[0-9]{1,2}(?:st|nd|rd|th)|[0-9]{4}s|[0-9]+%")
#: ``Passphrase is`` has its word before the ``is``. A number of a card's length has failed the check of cards.
_WORD_BEFORE = re.compile(r"([^\W\d]+)\W*(?:(?<=\W)(?<!\w)is\s*)?$")
_SENSITIVE = frozenset("token key secret password passwd passphrase passcode pwd api apikey api_key auth bearer ssn iban account acct card passport licence tel phone fax mobile id user login born dob konto ausweis compte cuenta".split())
_THINGS = frozenset("page chapter figure fig table section version license year volume vol issue line part item copyright isbn no number room step level day seite kapitel jahr tome año the a of in and to since about".split())
_PERSON_BEFORE = frozenset("name dear contact by from attn signed patient client customer author called mr mrs ms dr prof herr frau".split())
_PLACE_BEFORE = frozenset("address lives live lived living resides resident home at to anschrift wohnt adresse habite domicilio vive".split())


def _around(text: str, a: int, b: int) -> tuple[str, str, str]:
    """The token, what stands before it, and the word before it in lower case."""
    left = text[max(0, a - 24) : a]
    m = _WORD_BEFORE.search(left)
    return text[a:b], left, m[1].lower() if m else ""


def _changes(token: str) -> int:
    return sum(x.isdigit() != y.isdigit() for x, y in zip(token, token[1:]))


def _assigned(left: str) -> bool:
    return bool(left.strip()) and left.rstrip()[-1] in "\"'=:"


def votes(text: str, shape: int, a: int, b: int) -> tuple[int, ...]:
    """Of each labeler: 1 personal, -1 not, 0 no opinion."""
    token, left, word = _around(text, a, b)
    digits, letters = sum(c.isdigit() for c in token), sum(c.isalpha() for c in token)
    code = shape in (CODE, ASSIGNED)
    words = token.replace(".", "").split() if shape == NAME else []
    titled = bool(words) and words[0] in _TITLES
    plain = shape == ASSIGNED and token.isalpha() and token.islower()
    number = re.search("[0-9]+", token) if shape == ADDRESS else None
    return (
        (1 if _HEX.fullmatch(token) and letters and digits or _UUID.fullmatch(token) or _KEY.fullmatch(token) else -1 if len(token) < 6 else 0) if code else 0,
        (1 if _ACCOUNT.fullmatch(token) else -1 if _PLAIN.fullmatch(token) else 0) if code else 0,
        (1 if word in _SENSITIVE else -1 if word in _THINGS else 0) if code else 0,
        (1 if _assigned(left) else -1 if shape == CODE and word and left[-1:].isspace() and word not in _SENSITIVE else 0) if code else 0,
        (1 if _changes(token) >= 6 or digits >= 9 or len(set(token)) >= 12 and digits else -1 if plain or shape == CODE and (digits <= 5 and letters == 0 or letters >= 3 * digits) else 0) if code else 0,
        (1 if words[titled] in _GIVEN else -1) if len(words) > titled else 0,
        (1 if titled or word in _PERSON_BEFORE else -1 if word in _THINGS else 0) if words else 0,
        (-1 if not _NOT_NAMES.isdisjoint(words) else 1 if 2 <= len(words) - titled <= 3 else 0) if words else 0,
        (1 if int(number[0]) < 1900 or int(number[0]) > 2100 else -1) if number else 0,
        (1 if word in _PLACE_BEFORE or re.match(r",?\s[A-Z]{0,2}[0-9-]{4,}|,\s[^\W\d_a-z]", text[b : b + 12]) else -1 if word in ("chapter", "figure", "page", "version") else 0) if number else 0,
    )


def features(text: str, shape: int, a: int, b: int) -> tuple[int, ...]:
    """Bins that describe a candidate to the classifier: shape, length, share of digits, changes of kind, hexadecimal, sign and word before, first word, words that no name has."""
    token, left, word = _around(text, a, b)
    n = b - a
    digits = sum(c.isdigit() for c in token)
    sign = "\"'=:".find(left.rstrip()[-1:] or " ")
    words = token.replace(".", "").split() if shape == NAME else []
    return (
        shape,
        sum(n > k for k in (5, 8, 12, 15, 19, 31)),
        min(4, digits * 5 // n),
        sum(_changes(token) > k for k in (0, 2, 5, 9)),
        int(bool(_HEX.fullmatch(token))),
        sign + 1,
        1 if word in _SENSITIVE else 2 if word in _THINGS else 3 if word in _PERSON_BEFORE else 4 if word in _PLACE_BEFORE else 0,
        (1 if words[0] in _TITLES else 2 if words[0] in _GIVEN else 3) if words else 0,
        int(not _NOT_NAMES.isdisjoint(words)),
    )


LABELERS = 10
BINS = (4, 7, 5, 5, 2, 5, 5, 4, 2)


def _trimmed(token: str, a: int) -> tuple[int, int]:
    inner = token.strip(_TRIM)
    a += len(token) - len(token.lstrip(_TRIM))
    return a, a + len(inner)


def codes(text: str) -> Iterator[tuple[int, int]]:
    """Tokens with a digit, from the end of the one before or a sign that ends them."""
    free = 0
    for m in _FROM_DIGIT.finditer(text):
        a = m.start()
        while a > free and not _ENDS.match(text, a - 1):
            a -= 1
        free = m.end()
        yield _trimmed(text[a:free], a)


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Streets with a house number."""
    for m in _NUMBER_STREET.finditer(text):
        if m.start() == 0 or text[m.start() - 1] not in "0123456789.,-_" and not text[m.start() - 1].isalpha():
            yield m.span()
    for m in _STREET_NUMBER.finditer(text):
        start = _WORD_START.search(text, max(0, m.start() - 40), m.start())
        if start and (start.start() == 0 or not text[start.start() - 1].isalnum()):
            yield start.start(), m.end()
    if any(hint in text for hint in _CALLE_HINTS):
        yield from (m.span() for m in _CALLE_NUMBER.finditer(text))


def names(text: str) -> Iterator[tuple[int, int]]:
    """Runs of capitalised words that begin with a given name or a title, or follow a word that names people follow."""
    for m in _CAPITALS.finditer(text):
        a = m.start()
        if a and (text[a - 1].isalnum() or text[a - 1] == "_"):
            continue
        first = m[0].partition(" ")[0].rstrip(".")
        if first in _GIVEN or first in _TITLES or _around(text, a, m.end())[2] in _PERSON_BEFORE:
            yield m.span()


def candidates(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[int, int, int]]:
    """(shape, start, end) in order, of which none touches another or a span of a fixed kind; assigned values, addresses and names come before codes."""
    low = text.lower()
    values = _VALUE.finditer(text) if any(hint in low for hint in _VALUE_HINTS) else ()
    found = {
        ASSIGNED: [_trimmed(m[1], m.start(1)) for m in values if m.start() == 0 or not text[m.start() - 1].isalpha()],
        ADDRESS: sorted(addresses(text)),
        NAME: list(names(text)),
        CODE: list(codes(text)),
    }
    busy = sorted((a, b) for _, a, b in taken)
    for shape, spans in found.items():
        out, k = [], 0
        for a, b in spans:
            while k < len(busy) and busy[k][1] <= a:
                k += 1
            if a < b and not (k < len(busy) and busy[k][0] < b) and not (out and out[-1][1] > a):
                out.append((a, b, shape))
        if out:
            busy = sorted([*busy, *out], key=lambda x: x[:2])
    return [(x[2], x[0], x[1]) for x in busy if len(x) == 3]


#: What a labeler is taken to be before it is seen: right in so many of so many votes. This fixes which class is the personal one.
PRIOR_RIGHT, PRIOR_VOTES = 4.0, 5.0


def reliabilities(counts: dict[tuple[int, ...], int], rounds: int = 60) -> dict[tuple[int, ...], float]:
    """Probability that a candidate is personal, for each pattern of votes, by expectation maximisation.

    Each labeler has its own chance of voting for, where it votes, under either
    truth; an abstention says nothing. The start is the majority of votes, and
    each labeler begins with PRIOR_VOTES votes that are mostly right.
    """
    patterns = sorted(counts)
    n = np.array([counts[p] for p in patterns], float)
    v = np.array(patterns).reshape(len(patterns), -1)
    good = 1 / (1 + np.exp(-v.sum(axis=1).astype(float)))
    wrong = PRIOR_VOTES - PRIOR_RIGHT
    for _ in range(rounds):
        yes, no = good * n, (1 - good) * n
        odds = np.full(len(patterns), np.log((yes.sum() + 1) / (no.sum() + 1)))
        for x in v.T:
            up, down = x > 0, x < 0
            a = (yes[up].sum() + PRIOR_RIGHT) / (yes[up | down].sum() + PRIOR_VOTES)
            b = (no[up].sum() + wrong) / (no[up | down].sum() + PRIOR_VOTES)
            odds += up * np.log(a / b) + down * np.log((1 - a) / (1 - b))
        good = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
    return dict(zip(patterns, good.tolist()))


@dataclass(frozen=True)
class SpanClassifier:
    """Log-odds that a candidate is personal: a weight for each bin."""

    bias: float
    weights: tuple[tuple[float, ...], ...]

    def personal(self, bins: tuple[int, ...]) -> bool:
        return self.bias + sum(w[b] for w, b in zip(self.weights, bins)) > 0


def fit_classifier(counts: dict[tuple[tuple[int, ...], tuple[int, ...]], int], rounds: int = 400) -> SpanClassifier:
    """Logistic regression on counted (votes, bins), each as far positive as its votes' probability; deterministic."""
    by_votes: Counter = Counter()
    for (v, _), n in counts.items():
        by_votes[v] += n
    truth = reliabilities(by_votes) if by_votes else {}
    offset = np.cumsum([0, *BINS])
    pos, total = {}, Counter()
    for (v, b), n in sorted(counts.items()):
        total[b] += n
        pos[b] = pos.get(b, 0.0) + n * truth[v]
    rows = sorted(total)
    w = np.zeros(offset[-1] + 1)
    if rows:
        x = np.zeros((len(rows), len(w)))
        for k, b in enumerate(rows):
            x[k, [*(offset[:-1] + b), -1]] = 1
        n = np.array([total[b] for b in rows], float)
        y = np.array([pos[b] for b in rows]) / n
        n /= n.sum()
        for _ in range(rounds):  # Newton steps, shrunk a little
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            h = (x.T * (n * p * (1 - p))) @ x + 1e-4 * np.eye(len(w))
            step = np.linalg.solve(h, x.T @ (n * (y - p)) - 1e-4 * w)
            w += step / max(1.0, np.abs(step).max() / 2)
            if np.abs(step).max() < 1e-9:
                break
    return SpanClassifier(float(w[-1]), tuple(tuple(w[a:b].tolist()) for a, b in zip(offset, offset[1:])))


def base_and_candidates(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int, list[int]]]]:
    """Spans of the fixed kinds, and candidates as (kind, start, end, votes and bins): a code with letters is a secret, one without a number."""
    base, more = base_spans(text), []
    for shape, a, b in candidates(text, base):
        kind = {NAME: "name", ADDRESS: "address", ASSIGNED: "secret"}.get(shape) or ADDED[not any(c.isalpha() for c in text[a:b])]
        more.append((kind, a, b, [*votes(text, shape, a, b), *features(text, shape, a, b)]))
    return base, more


def train(found: DataFrame) -> SpanClassifier:
    """Learns from all candidates of all documents. What comes to the driver are counts by votes and bins, of which there is a fixed number."""
    counts = {}
    for code, n in found.select(F.explode("more.code").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[tuple(code[:LABELERS]), tuple(code[LABELERS:])] = n
    return fit_classifier(counts)


def chosen(base: list[tuple[str, int, int]], more: Iterable[tuple[str, int, int, list[int]]], model: SpanClassifier) -> list[tuple[str, int, int]]:
    """Base spans, then what the classifier takes for personal, by kind and start."""
    added = [(k, a, b) for k, a, b, code in more if model.personal(tuple(code[LABELERS:]))]
    return base + sorted(added, key=lambda s: (ADDED.index(s[0]), s[1]))


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
_MORE = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("code", pa.list_(pa.int32()))])


def _searched(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans, more = [], []
        for t in batch.column(1):
            base, rest = base_and_candidates(t.as_py() or "")
            spans.append([dict(zip(("kind", "start", "end"), x)) for x in base])
            more.append([dict(zip(("kind", "start", "end", "code"), x)) for x in rest])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(_SPAN)), pa.array(more, pa.list_(_MORE))], ["doc_id", "spans", "more"])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, spans``, an array of (kind, start, end) in code points, end exclusive.

    Base kinds come in the order of BASE, then what the classifier adds in that
    of ADDED, each by start. A span is added only where it touches no other.
    Texts are searched once; base spans and candidates are written, the
    classifier learns from the candidates and judges them.

    Null text is empty and has none. Repeated rows each get their row and each
    count in training. An empty table gives an empty result; further columns are
    ignored.
    """
    span = T.StructType().add("kind", "string").add("start", "long").add("end", "long")
    more = T.StructType(list(span.fields)).add("code", T.ArrayType(T.IntegerType()))
    schema = T.StructType().add("doc_id", docs.schema[id_col].dataType).add("spans", T.ArrayType(span)).add("more", T.ArrayType(more))
    found = written(docs.select(named(id_col).alias("doc_id"), named(text_col).alias("text")).mapInArrow(_searched, schema))
    model = train(found)

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            spans = [chosen([tuple(x.values()) for x in base], (tuple(x.values()) for x in rest), model) for base, rest in rows]
            out = [[dict(zip(("kind", "start", "end"), x)) for x in s] for s in spans]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(_SPAN))], ["doc_id", "spans"])

    return found.mapInArrow(emit, T.StructType(schema.fields[:2]))
