"""Personal data by weak supervision: labelers vote on candidate spans, and a span classifier learns from their votes.

Four base kinds (e-mail, IP address, card, phone) are found by fixed patterns and always kept. Further candidates, such
as national phone numbers, bank accounts, credentials and names, come from looser patterns. On each candidate six
labelers vote for, against or not at all: strict and loose regular expressions, structure (checksums, lengths), a
gazetteer, the context to the left, the shape of the span and misleading context. How often each pattern of votes
occurs is counted over all documents; expectation-maximisation estimates from these counts how reliable each labeler
is and how likely each pattern is personal data, and a logistic span classifier is trained on that and on the span's
form. Candidates that it accepts are added.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, checkpoint, map_rows, map_texts

BASE = ("email", "ip", "card", "phone")
ADDED = ("localphone", "account", "ssn", "payment", "secret", "name", "handle")

LOCAL = r"A-Za-z0-9._%+-"
EMAIL_TAIL = rf"[{LOCAL}]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
EMAIL_HERE, EMAIL_NEXT = re.compile(EMAIL_TAIL), re.compile(rf"(?<![{LOCAL}]){EMAIL_TAIL}")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

LOOSE = {
    "localphone": re.compile(r"(?<![\w+.-])(?:\([0-9]{2,5}\)|[0-9]{2,5})[ ./-]{1,2}[0-9]{3,4}[ .-][0-9]{2,4}(?:[ .-][0-9]{2,4})?(?![\w-])"),
    "account": re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"),
    "ssn": re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"),
    "payment": re.compile(r"(?<!\w)[0-9]{13,19}(?!\w)"),
    "secret": re.compile(r"(?<!\w)(?:[A-Z]{4}[A-Z0-9]{12,20}|[0-9a-f]{16,128}|[a-z]{2,4}[-_][A-Za-z0-9_]{16,80})(?!\w)"),
    "name": re.compile(r"(?<!\w)(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Señor|Señora)\.? [A-ZÀ-Þ][a-zß-ÿ]+(?: [A-ZÀ-Þ][a-zß-ÿ]+){0,2}(?!\w)"),
    "handle": re.compile(r"(?<![\w@./+%-])@[A-Za-z_][A-Za-z0-9_]{2,30}(?![\w@.])"),
}
STRICT = {
    "localphone": re.compile(r"\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4}|0[0-9]{2,4}[ /-][0-9]{3,4}[ -][0-9]{2,4}(?:[ -][0-9]{2,4})?"),
    "account": re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9 ]{11,34}"),
    "ssn": re.compile(r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}"),
    "payment": re.compile(r"4[0-9]{12,18}|5[1-5][0-9]{14}|3[47][0-9]{13}|6[0-9]{15,18}"),
    "secret": re.compile(r"(?:AKIA|ASIA)[A-Z0-9]{12,18}|[0-9a-f]{18,}|(?:sk|pk|ghp|gho|xox[bp])[-_][A-Za-z0-9_]{16,}"),
    "name": re.compile(r"\S+ \S+(?: \S+)+"),
    "handle": re.compile(r"@[a-z][a-z0-9_]{3,20}"),
}
#: Gazetteers (fixed values): given names; words that name the field a span of the kind stands in.
GIVEN_NAMES = frozenset(
    "james mary john anna peter maria paul laura david sarah michael julia thomas emma daniel lena hans klaus petra ursula jean pierre "
    "marie claire luc sophie carlos jose juan carmen lucia pablo elena miguel ana".split()
)
CUES = {
    "localphone": "phone tel call mobile fax cell telefon handy téléphone teléfono móvil",
    "account": "iban account bank konto compte cuenta bic",
    "ssn": "ssn social security insurance",
    "payment": "card visa mastercard amex karte carte tarjeta payment",
    "secret": "password passwd pwd token secret key apikey api_key passphrase credential credentials bearer access",
    "name": "name contact regards sincerely dear attn signed kontakt nom nombre",
    "handle": "follow twitter instagram user account via handle",
}
CUES = {k: frozenset(v.split()) for k, v in CUES.items()}
#: Beginnings of keys that issuers give out (fixed values); they name a span's field as well as a word before it does.
KEY_PREFIXES = ("AKIA", "ASIA", "AIza", "ghp_", "gho_", "sk_", "sk-", "pk_", "pk-", "xoxb-", "xoxp-")
MISLEADING = frozenset("version isbn issn page pages figure table chapter section commit sha sha1 sha256 md5 checksum hash build rev revision doi".split())
WORDS = re.compile(r"[^\W\d]+")
#: A sign of assignment, or a country's calling code, just before a span.
LEADS_IN = re.compile(r"[:=]\s*[\"']?$|\+[0-9]{1,3} $")
CALLING_CODE = re.compile(r"(?:\+|00)(?:1|[2-9][0-9]{0,2}) $")
LABELERS = 6
#: Characters to the left of a span that the context labelers read.
CONTEXT = 40
ACCEPT = 0.5
FORMS = 8 * 4 * 16 * 4

SPAN = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType())])
CANDIDATE = T.StructType([*SPAN.fields, T.StructField("code", T.IntegerType())])


def luhn(digits: str) -> bool:
    """Whether the check digit fits."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, begin, end) of the base kinds in order: leftmost, without overlaps within a kind."""
    out = []
    if "@" in text:
        at = 0
        while m := (EMAIL_HERE.match(text, at) if at else None) or EMAIL_NEXT.search(text, at):
            out.append((0, *m.span()))
            at = m.end()
    if DIGIT.search(text):
        out += [(1, *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = re.sub("[ -]", "", m[0])
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out.append((2, *m.span()))
        if "+" in text:
            out += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return out


def structure_vote(kind: str, span: str) -> int:
    digits = sum(c.isdigit() for c in span)
    if kind == "account":
        plain = span.replace(" ", "")
        number = "".join(str(int(c, 36)) for c in plain[4:] + plain[:4])
        return 1 if int(number) % 97 == 1 else -1
    if kind == "payment":
        return 1 if luhn(span) else -1
    if kind == "localphone":
        return 1 if 9 <= digits <= 11 else -1
    if kind == "secret":
        return 1 if digits >= 2 and digits < len(span) - 3 else -1
    if kind == "ssn":
        return 1 if len(set(span)) > 3 else -1
    if kind == "name":
        return 1 if span.count(" ") >= 2 else 0
    return 1 if any(c.islower() for c in span) else -1


def known(kind: str, span: str) -> bool:
    """Whether a gazetteer has a part of the span."""
    if kind == "name":
        return bool(set(WORDS.findall(span.lower())) & GIVEN_NAMES)
    if kind == "payment":
        return luhn(span) and STRICT[kind].fullmatch(span) is not None
    return kind == "secret" and span.startswith(KEY_PREFIXES)


def entropy(span: str) -> float:
    counts = [span.count(c) for c in set(span)]
    return -sum(n / len(span) * math.log2(n / len(span)) for n in counts)


def form(span: str, before: str) -> int:
    """Length in steps of 8, share of digits in quarters, kinds of characters, and kind of the character before, as one number below ``FORMS``."""
    digits = sum(c.isdigit() for c in span)
    kinds = (digits > 0) + 2 * any(c.isupper() for c in span) + 4 * any(c.islower() for c in span) + 8 * any(not c.isalnum() for c in span)
    left = 0 if not before or before.isspace() else 1 if before in "=:\"'" else 2 if before.isalnum() else 3
    return ((min(7, len(span) // 8) * 4 + min(3, 4 * digits // len(span))) * 16 + kinds) * 4 + left


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(kind, begin, end, code) of further spans that overlap neither base spans nor each other.

    The code holds the votes, each as 0 (against), 1 (none) or 2 (for), then the kind and the span's form.
    """
    out = []
    digit = DIGIT.search(text) is not None
    busy: list[tuple[int, int]] = []  # disjoint, in order
    for a, b in sorted((a, b) for _, a, b in taken):
        if busy and a < busy[-1][1]:
            busy[-1] = busy[-1][0], max(b, busy[-1][1])
        else:
            busy.append((a, b))
    for k, kind in enumerate(ADDED):
        if kind == "handle" and "@" not in text or kind not in ("name", "handle") and not digit:
            continue
        for m in LOOSE[kind].finditer(text):
            a, b = m.span()
            before = bisect_left(busy, (b,))
            if before and busy[before - 1][1] > a:
                continue
            span = m[0]
            left = text[max(0, a - CONTEXT) : a].lower()
            words = WORDS.findall(left)[-3:]
            near = set(words) | {left.rstrip(" \"'=:").rpartition(" ")[2]}
            votes = (
                1 if STRICT[kind].fullmatch(span) else -1,
                structure_vote(kind, span),
                1 if known(kind, span) or near & CUES[kind] or kind == "localphone" and CALLING_CODE.search(left) else 0,
                1 if LEADS_IN.search(left) else 0,
                1 if entropy(span) >= (3.0 if kind == "secret" else 2.0) else -1,
                -1 if near & MISLEADING else 0,
            )
            code = 0
            for v in votes:
                code = code * 3 + v + 1
            out.append((k, a, b, (code * len(ADDED) + k) * FORMS + form(span, text[a - 1 : a])))
            insort(busy, (a, b))
    return out


def estimate(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of each code to be personal data, and the labelers' reliabilities, by expectation-maximisation.

    Given the truth, labelers vote independently; a labeler's votes for (truth, vote) are shared by all kinds, the
    share of true spans is that of the kind. The start is the majority vote.
    """
    kind = codes // FORMS % len(ADDED)
    votes = np.stack([codes // FORMS // len(ADDED) // 3 ** (LABELERS - 1 - i) % 3 for i in range(LABELERS)], 1)
    balance = (votes - 1).sum(1)
    p = 1 / (1 + np.exp(-balance.astype(float)))
    table = np.zeros((2, LABELERS, 3))
    for _ in range(100):
        for truth, w in ((0, counts * (1 - p)), (1, counts * p)):
            for i in range(LABELERS):
                seen = np.bincount(votes[:, i], w, 3) + 0.5
                table[truth, i] = seen / seen.sum()
        prior = (np.bincount(kind, counts * p, len(ADDED)) + 1) / (np.bincount(kind, counts, len(ADDED)) + 2)
        score = np.log(prior / (1 - prior))[kind]
        for i in range(LABELERS):
            score = score + np.log(table[1, i, votes[:, i]] / table[0, i, votes[:, i]])
        new = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        if np.abs(new - p).max(initial=0) < 1e-6:
            break
        p = new
    return p, table


def features(codes: np.ndarray) -> np.ndarray:
    """One column for each vote of each labeler, kind and feature of the span's form, which labelers don't see, and a constant."""
    shape, base = codes % FORMS, codes // FORMS
    columns = [np.ones(len(codes)), *(base % len(ADDED) == k for k in range(len(ADDED)))]
    for i in range(LABELERS):
        vote = base // len(ADDED) // 3 ** (LABELERS - 1 - i) % 3
        columns += [vote == 0, vote == 2]
    left, kinds, share, length = shape % 4, shape // 4 % 16, shape // 64 % 4, shape // 256
    columns += [left == i for i in range(1, 4)] + [share == i for i in range(1, 4)] + [length == i for i in range(1, 8)]
    columns += [kinds >> i & 1 for i in range(4)]
    return np.stack(columns, 1).astype(float)


def classify(codes: np.ndarray, counts: np.ndarray) -> dict[int, float]:
    """The classifier's probability for each code: logistic regression on the estimated truth, by Newton's method."""
    if not len(codes):
        return {}
    p, _ = estimate(codes, counts)
    x, w = features(codes), np.zeros(0)
    w = np.zeros(x.shape[1])
    share = counts / counts.sum()
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (share * (q - p)) + 1e-3 * w
        bend = (x * (share * q * (1 - q))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return dict(zip(codes.tolist(), (1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))).tolist()))


def scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id_col, base, more``: base spans and candidates of every text."""
    schema = T.StructType(
        [docs.select(id_col).schema[0], T.StructField("base", T.ArrayType(SPAN)), T.StructField("more", T.ArrayType(CANDIDATE))]
    )

    def structs(rows: list[list[tuple]], names: list[str]) -> pa.Array:
        flat = np.array([x for r in rows for x in r], np.int32).reshape(-1, len(names))
        ends = np.r_[0, np.cumsum([len(r) for r in rows])].astype(np.int32)
        fields = [pa.array(np.ascontiguousarray(flat[:, i])) for i in range(len(names))]
        return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(fields, names=names))

    def make():
        def work(part, texts):
            base = [base_spans(t) for t in texts]
            more = [candidates(t, b) for t, b in zip(texts, base)]
            return {id_col: part.column(0), "base": structs(base, SPAN.names), "more": structs(more, CANDIDATE.names)}

        return work

    return map_texts(docs.select(F.col(id_col), F.col(text_col).cast("string")), [id_col, text_col], text_col, make, schema)


def train(found: DataFrame) -> dict[int, float]:
    """The probability of each code that occurs in ``more``, from its count over all rows.

    There are at most 3 ** 6 * 7 * 2,048 codes, of which real texts show some hundreds, however many they are.
    """
    rows = found.select(F.explode("more.code").alias("code")).groupBy("code").agg(F.count("*").alias("n")).orderBy("code").collect()
    return classify(np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], float))


def listed(spans: list[tuple[int, int, int]]) -> str:
    kinds = BASE + ADDED
    return ",".join(f"{kinds[k]}:{a}:{b}" for k, a, b in sorted(spans))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of personal data of every whole text.

    Returns ``id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added``; ``spans`` lists kind:begin:end in
    characters (end exclusive), base kinds first. A null text counts as empty: no spans. Repeated rows give repeated
    rows (and count as often in training), an empty table an empty one; other columns are ignored.
    """
    found = checkpoint(scan(docs, id_col, text_col))
    accepted = {c for c, p in train(found).items() if p >= ACCEPT}
    schema = T.StructType(
        [
            docs.select(id_col).schema[0],
            *(T.StructField(f"n_{k}", T.LongType()) for k in BASE),
            T.StructField("base_sha256", T.StringType()),
            T.StructField("spans", T.StringType()),
            T.StructField("n_added", T.LongType()),
        ]
    )
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in range(7)]
            for base, more in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                own = [(s["kind"], s["begin"], s["end"]) for s in base]
                added = [(len(BASE) + s["kind"], s["begin"], s["end"]) for s in more if s["code"] in accepted]
                for k in range(4):
                    columns[k].append(sum(s[0] == k for s in own))
                columns[4].append(hashlib.sha256(listed(own).encode()).hexdigest())
                columns[5].append(listed(own + added))
                columns[6].append(len(added))
            arrays = [batch.column(0), *(pa.array(c, arrow.field(i + 1).type) for i, c in enumerate(columns))]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return found.mapInArrow(run, schema)


def redact(text: str, spans: str) -> str:
    """The text with each listed span replaced by its kind in angle brackets; of spans that overlap, the first is kept whole."""
    out, at = [], 0
    parts = (s.split(":") for s in spans.split(",") if s)
    merged: list[list] = []
    for kind, a, b in sorted(((k, int(a), int(b)) for k, a, b in parts), key=lambda s: (s[1], -s[2])):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([kind, a, b])
    for kind, a, b in merged:
        out += [text[at:a], f"<{kind.upper()}>"]
        at = b
    return "".join([*out, text[at:]])


def redact_all(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span that ``find`` lists replaced by its kind, such as <EMAIL>; null texts stay null."""
    accepted = {c for c, p in train(checkpoint(scan(docs, id_col, text_col).select("more"))).items() if p >= ACCEPT}

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        base = base_spans(text)
        added = [(len(BASE) + k, a, b) for k, a, b, code in candidates(text, base) if code in accepted]
        return redact(text, listed(base + added))

    def make():
        def work(part: pa.RecordBatch, texts: list[str | None]) -> pa.RecordBatch:
            at = part.schema.get_field_index(text_col)
            return part.set_column(at, part.schema.field(at), pa.array([clean(t) for t in texts], part.schema.field(at).type))

        return work

    return map_rows(docs.withColumn(text_col, F.col(text_col).cast("string")), text_col, make)
