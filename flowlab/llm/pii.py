"""Personal data by a semi-Markov conditional random field beside base rules.

The base rules (email, ip, card, phone) are regular expressions with a check
of each match; their spans always stay.  They also label the training rows:
a bounded sample of regions around digits and at-signs, each with its base
spans, and rewritten forms of them (a phone number without its country code, a
bracketed "at", other separators; and, as counterexamples, a wrong check
digit, a part over 255, dates, versions) teach a semi-Markov field
(``semi_markov``) whose features look at whole spans: digit counts, check
digits, group shapes, neighbours and cue words.  Its best segmentation of a
region adds the entities that no base span overlaps.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlab.llm.common import small_batches
from flowlab.llm.semi_markov import LONGEST, Candidate, SemiMarkov, train

KINDS = ["email", "ip", "card", "phone"]
SAMPLE = 800            # regions with, and regions without base spans that the model is fitted on
CONTEXT = 24            # characters kept on either side of a sampled region
REGION = 200            # characters of a region in the sample at most
CUES = {"email": {"mail", "email", "contact", "write"}, "ip": {"ip", "host", "server", "address", "addr"},
        "card": {"card", "visa", "mastercard", "credit", "debit"},
        "phone": {"tel", "phone", "telephone", "call", "mobile", "cell", "fax"}}

Span = tuple[str, int, int]

# ---------------------------------------------------------------- base rules

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# a match starts at the first digit of a run: where that fails, the run's other digits fail alike
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def digits(s: str) -> str:
    return "".join(_DIGIT.findall(s))


def luhn(number: str) -> bool:
    total = 0
    for k, ch in enumerate(reversed(number)):
        d = int(ch) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the base rules, by kind and start, leftmost and without overlap
    within a kind; linear in the text."""
    out: list[Span] = []
    at, taken = text.find("@"), 0
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        if domain:
            start = at
            while start > taken and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                taken = domain.end()
                out.append(("email", start, taken))
        at = text.find("@", at + 1)
    if _DIGIT.search(text):
        # four digits decide as well as more: a part of any length is compared without turning it into a number
        out += [("ip", *m.span()) for m in _IP.finditer(text)
                if all(int(p.lstrip("0")[:4] or 0) <= 255 for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            number = digits(m.group())
            if 16 <= len(number) <= 19 and luhn(number):
                out.append(("card", *m.span()))
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(digits(m.group())) <= 15]
    return out


# ---------------------------------------------------------------- regions and candidates

_AT = re.compile(r"\x20?@\x20?|\x20?[(\[]at[)\]]\x20?")
_NUMBERS = re.compile(r"\+?\(?[0-9]++(?:[\x20().+/-]{1,3}[0-9]++)*+")
_TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|(?s:.)")
RUNS = 7                # digit runs of a number at most
_AROUND = 12            # tokens of an address on either side of its at


def regions(text: str) -> list[tuple[int, int]]:
    """Stretches that may hold an entity: chains of digit runs with short
    separators (four digits or more), and what stands around an at-sign;
    overlapping and touching ones are one."""
    found = []
    for m in _NUMBERS.finditer(text) if _DIGIT.search(text) else ():
        if m.end() - m.start() >= 4 and len(digits(m.group()[:64])) >= 4:
            found.append(m.span())
    if "@" in text or "at)" in text or "at]" in text:
        for m in _AT.finditer(text):
            lo, hi = m.span()
            while lo > 0 and m.start() - lo < 64 and text[lo - 1] in _LOCAL:
                lo -= 1
            while hi < len(text) and hi - m.end() < 128 and text[hi] in _LOCAL:
                hi += 1
            if lo < m.start() and m.end() < hi:
                found.append((lo, hi))
    found.sort()
    out: list[tuple[int, int]] = []
    for lo, hi in found:
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _side(text: str, at: int, step: int) -> str:
    """Kind of neighbour at ``text[at]``; a separator with a digit behind it
    means that the number goes on."""
    if not 0 <= at < len(text):
        return "edge"
    ch = text[at]
    if ch.isspace():
        return "space"
    if ch.isalnum():
        return "digit" if ch in "0123456789" else "letter"
    beyond = at + step
    return "goes_on" if 0 <= beyond < len(text) and text[beyond] in "0123456789" else "sign"


def features(kind: str, text: str, start: int, end: int) -> tuple[str, ...]:
    """Names of the features that a whole span of a kind has."""
    s = text[start:end]
    words = re.findall(r"[A-Za-z]+", text[max(0, start - CONTEXT):start])
    out = ["any", f"left={_side(text, start - 1, -1)}", f"right={_side(text, end, 1)}"]
    if words and words[-1].lower() in CUES[kind]:
        out.append("cue")
    if kind == "email":
        at = _AT.search(s)
        local, domain, sign = s[:at.start()], s[at.end():], at.group()
        labels = domain.split(".")
        out += [f"at={'plain' if sign == '@' else 'spaced' if '@' in sign else 'word'}",
                f"local={bool(re.fullmatch(r'[A-Za-z0-9_%+-]+([.][A-Za-z0-9_%+-]+)*', local))}",
                f"labels={min(len(labels), 4)}", f"top={bool(re.fullmatch('[A-Za-z]{2,}', labels[-1]))}",
                f"domain={bool(re.fullmatch('[A-Za-z0-9-]+([.][A-Za-z0-9-]+)+', domain))}"]
    else:
        number, groups = digits(s), re.findall(r"[0-9]+", s)
        signs = "".join(sorted(set(s) - set("0123456789")))
        if kind == "ip":
            out += [f"parts={min(len(groups), 5)}", f"octets={all(int(g[:4]) <= 255 for g in groups)}",
                    f"zero={any(len(g) > 1 and g[0] == '0' for g in groups)}"]
        elif kind == "card":
            out += [f"digits={len(number)}", f"luhn={luhn(number)}", f"signs={signs}",
                    f"groups={'one' if len(groups) == 1 else 'fours' if {len(g) for g in groups} == {4} else 'other'}"]
        else:
            shape = "-".join(str(len(g)) for g in groups[-3:])
            out += [f"digits={len(number)}", f"plus={s[0] == '+'}", f"pairs={s.count('(') == s.count(')')}",
                    f"groups={min(len(groups), 6)}", f"shape={shape if len(groups) > 1 else 'one'}",
                    f"signs={signs.replace('+', '')}"]
    return tuple(f"{kind}:{f}" for f in out)


def candidates(text: str, lo: int, hi: int) -> tuple[list[int], list[Candidate]]:
    """Token borders of a region and the spans that may be entities."""
    marks = [lo, *(m.end() for m in _TOKEN.finditer(text, lo, hi))]
    tokens = [text[a:b] for a, b in zip(marks, marks[1:])]
    numeric = [t[0] in "0123456789" for t in tokens]
    sizes = [len(t) if d else 0 for t, d in zip(tokens, numeric)]
    out: list[Candidate] = []

    def add(i, j, kind):
        out.append((i, j, kind, features(kind, text, marks[i], marks[j])))

    for i, first in enumerate(tokens):
        if not numeric[i] and first not in "+(":
            continue
        count, runs, chars = 0, 0, set()
        for j in range(i, min(i + LONGEST, len(tokens))):
            count += sizes[j]
            runs += numeric[j]
            if count > 19 or runs > RUNS or tokens[j] not in " ().+/-" and not numeric[j]:
                break
            if not numeric[j]:
                chars.add(tokens[j])
                if j > i and tokens[j] == "+":
                    break
                continue
            if count < 4:
                continue
            if numeric[i] and chars == {"."} and runs == 4:
                add(i, j + 1, "ip")
            if numeric[i] and 12 <= count <= 19 and chars <= set(" .-/"):
                add(i, j + 1, "card")
            if 7 <= count <= 15:
                add(i, j + 1, "phone")
    at_token = {m: k for k, m in enumerate(marks)}
    for m in _AT.finditer(text, lo, hi):
        # the sign may stand inside a token run: its borders are token borders, because only letters and digits form runs
        a, b = at_token.get(m.start()), at_token.get(m.end())
        if a is None or b is None:
            continue
        starts = []
        for i in range(a - 1, max(a - _AROUND, 0) - 1, -1):
            if not set(tokens[i]) <= _LOCAL:
                break
            starts.append(i)
        for j in range(b, min(b + _AROUND, len(tokens))):
            if not set(tokens[j]) <= _LOCAL:
                break
            if "." in tokens[b:j]:
                for i in starts:
                    add(i, j + 1, "email")
    return marks, out


# ---------------------------------------------------------------- training rows

def _separate(spans: list[Span]) -> list[Span]:
    """Spans without overlap: kinds as listed come first."""
    out: list[Span] = []
    for s in spans:
        if all(s[2] <= o[1] or o[2] <= s[1] for o in out):
            out.append(s)
    return out


def example(text: str, lo: int, hi: int, spans: list[Span]) -> tuple[int, list[Candidate], frozenset] | None:
    """A region as a training example; None where a span is no candidate."""
    marks, found = candidates(text, lo, hi)
    at = {m: k for k, m in enumerate(marks)}
    gold = frozenset((at.get(s, -1), at.get(e, -1), kind) for kind, s, e in spans)
    return (len(marks) - 1, found, gold) if gold <= {c[:3] for c in found} else None


def rewritten(kind: str, s: str, k: int) -> list[tuple[str, bool]]:
    """Other forms of a base span, and whether they still are personal data;
    ``k`` varies the counterexamples."""
    if kind == "email":
        local, domain = s.split("@", 1)
        return [(f"{local} (at) {domain}", True), (f"{local}[at]{domain}", True), (f"{local} @ {domain}", True),
                (f"{local}@{domain.split('.')[0]}", False)]
    if kind == "ip":
        parts = s.split(".")
        return [(".".join([str(256 + k % 700), *parts[1:]]), False), (f"{k % 9}.{k % 13}.{k % 7}", False),
                (s + f".{k % 50}", False)]
    number = digits(s)
    if kind == "card":
        fours = [number[i:i + 4] for i in range(0, len(number), 4)]
        wrong = number[:-1] + str((int(number[-1]) + 1 + k % 8) % 10)
        return [(".".join(fours), True), ("/".join(fours), True), (" - ".join(fours), True), (wrong, False),
                (" ".join(wrong[i:i + 4] for i in range(0, len(wrong), 4)), False)]
    local, area = number[-7:], number[-10:-7]
    more = [(f"({area}) {local[:3]}-{local[3:]}", True), (f"{area}-{local[:3]}-{local[3:]}", True),
            (f"{area}.{local[:3]}.{local[3:]}", True), (f"{area} {local[:3]} {local[3:]}", True)] if len(area) == 3 else []
    return [*more, (f"{1900 + k % 130}-{1 + k % 12:02d}-{1 + k % 28:02d}", False), (number, False),
            (f"{1900 + k % 100}-{1950 + k % 80}", False), (f"{k % 900 + 100} {k % 9000 + 1000}", False),
            (f"{k % 90}.{k % 1000:03d}.{k % 997:03d}", False)]


def examples(sample: list[tuple[str, int, int, list[Span]]]) -> list[tuple[int, list[Candidate], frozenset]]:
    """Training examples of the sampled regions (text, start, end, base spans)
    and of the rewritten forms of their spans, in a fixed order."""
    out = []
    for k, (text, lo, hi, spans) in enumerate(sample):
        first = example(text, lo, hi, _separate(spans))
        if first:
            out.append(first)
        for kind, start, end in spans[:1] if len(spans) == 1 else ():
            for form, personal in rewritten(kind, text[start:end], k):
                changed = text[:start] + form + text[end:]
                stop = start + len(form)
                for a, b in regions(changed):
                    if a <= start < b:
                        gold = [(kind, start, stop)] if personal else []
                        out.append(example(changed, a, b, gold))
    return [e for e in out if e]


def sampled_regions(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> list[tuple[str, int, int, list[Span]]]:
    """At most ``sample`` different regions with and as many without base
    spans, from all texts, the ones with the least md5 (so the same ones in any
    layout); a region of more than REGION characters teaches nothing new."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(0).to_pylist():
                found = regions(text) if text else []
                spans = base_spans(text) if found else []
                for lo, hi in found:
                    if hi - lo <= REGION:
                        start = max(0, lo - CONTEXT)
                        inside = [{"kind": k, "start": s - start, "end": e - start} for k, s, e in spans if lo <= s and e <= hi]
                        rows.append((text[start:hi + CONTEXT], lo - start, hi - start, inside))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 4, (
                    pa.string(), pa.int32(), pa.int32(),
                    pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))))],
                ["text", "lo", "hi", "spans"])

    with small_batches(docs.sparkSession):
        found = docs.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(
            run, "text string, lo int, hi int, spans array<struct<kind:string,start:int,end:int>>")
        found = found.groupBy("text", "lo", "hi").agg(F.first("spans").alias("spans"))
        order = F.md5(F.concat_ws(":", "lo", "hi", "text"))
        some = F.size("spans") > 0
        ranked = found.withColumn("some", some).withColumn("order", order)
        ranked = ranked.where("some").orderBy("order", "lo", "text").limit(sample).unionByName(
            ranked.where("NOT some").orderBy("order", "lo", "text").limit(sample))
        rows = ranked.collect()                 # 2 * sample regions of REGION + 2 * CONTEXT characters at most
    rows.sort(key=lambda r: (r["order"], r["lo"], r["text"]))
    return [(r["text"], r["lo"], r["hi"], [(s["kind"], s["start"], s["end"]) for s in r["spans"]]) for r in rows]


def fit(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> SemiMarkov:
    """A model from the bounded sample; no weights, so no added spans, where
    the texts have no base span at all."""
    rows = sampled_regions(docs, text_col, sample)
    return train(examples(rows)) if any(spans for *_, spans in rows) else SemiMarkov()


# ---------------------------------------------------------------- scan

def added_spans(text: str, model: SemiMarkov, base: list[Span]) -> list[Span]:
    """The entities of every region's best segmentation that overlap no base span."""
    out = []
    for lo, hi in regions(text) if model.weights else ():
        near = [s for s in base if s[1] < hi and lo < s[2]]
        marks, found = candidates(text, lo, hi)
        for a, b, kind in model.best(len(marks) - 1, found):
            start, end = marks[a], marks[b]
            if all(end <= s or e <= start for _, s, e in near):
                out.append((kind, start, end))
    return out


def scan(docs: DataFrame, model: SemiMarkov, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ``spans``: array of (kind, start, end, base), in code points, end
    exclusive, by kind as listed, then start; ``base`` tells the spans of the
    base rules from the model's.

    Null and empty texts have none.  Whole texts of any length are read;
    repeated rows are scanned alike and kept, extra columns are ignored, an
    empty table gives no rows."""
    kind_of = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
    rank = {k: i for i, k in enumerate(KINDS)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column(1).to_pylist():
                base = base_spans(text) if text else []
                every = [(*s, True) for s in base] + [(*s, False) for s in (added_spans(text, model, base) if text else [])]
                every.sort(key=lambda s: (rank[s[0]], s[1]))
                found.append([dict(zip(("kind", "start", "end", "base"), s)) for s in every])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind_of)], ["id", "spans"])

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {id_type}, spans array<struct<kind:string,start:bigint,end:bigint,base:boolean>>")
    return out.withColumnRenamed("id", id_col)
