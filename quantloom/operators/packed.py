"""Several values packed in one field, split by a parsing expression grammar.

::

    field   <- blank* count? items blank* !.
    count   <- digits '/'                      only before an item
    items   <- item? (separator item?)*
    item    <- bracketed / quoted / triple / bare
    bracketed <- '[' items ']' / '{' items '}' / '(' items ')'   balanced and filling its place
    quoted  <- '"' ('""' / '\\' any / !'"' any)* '"' &(separator / closer / end)   and the same with "'"
    triple  <- database '|' accession '|' entry   one accession in three parts
    bare    <- (!separator !closer any)+
    separator <- blank* [;,/|&] blank* / blank+   and their full-width forms

Alternatives are tried in order; where one fails the parser goes back to its start and tries
the next, so a quote that is never closed becomes part of a bare value and sets its error flag.
Results are remembered by place and closing sign (packrat parsing) and the parser keeps its own stack, so
time and memory grow with the length of the text whatever the depth or number of its brackets.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Signs between values, opening and closing signs.
SEPARATORS = ";,/|&；，、／｜＆"
CLOSERS = {"[": "]", "{": "}", "(": ")"}

_BLANKS = re.compile(r"\s*")
_COUNT = re.compile(r"\d+/(?=\s*[^\s/])")
_GAP = re.compile(rf"\s*[{re.escape(SEPARATORS)}]\s*|\s+")
_TRIPLE = re.compile(r"(?:[A-Za-z]+[_-])?[a-z]{2,3}\|[A-Za-z0-9_.-]+\|[A-Za-z0-9]+_[A-Za-z0-9]+")
_BREAK = {closer: re.compile(rf"[\s{re.escape(SEPARATORS + closer)}]") for closer in ["", *CLOSERS.values()]}
_QUOTED = {
    '"': re.compile(r'"((?:""|\\.|[^"\\])*)"', re.S),
    "'": re.compile(r"'((?:''|\\.|[^'\\])*)'", re.S),
}
_ESCAPE = {q: re.compile(rf"{q}{q}|\\([{q}\\/])") for q in _QUOTED}

Value = tuple[str, bool]


class _Parser:
    """The items of one text. ``step[at, closer]`` is what stands at a place under a closing sign, as (kind, detail, place after it);
    ``end[at, closer]`` is where the items from there on stop."""

    def __init__(self, text: str):
        self.text = text
        self.step: dict[tuple[int, str], tuple] = {}
        self.end: dict[tuple[int, str], int] = {}
        self._breaks: dict[str, list[int]] = {}
        self._quotes: dict[int, tuple[str, int] | None] = {}

    def _ends(self, at: int, closer: str) -> bool:
        return at == len(self.text) or (closer != "" and self.text[at] == closer) or _GAP.match(self.text, at) is not None

    def _bare_end(self, at: int, closer: str) -> int:
        """The first blank, separator or closing sign after ``at``."""
        breaks = self._breaks.get(closer)
        if breaks is None:
            breaks = self._breaks[closer] = [m.start() for m in _BREAK[closer].finditer(self.text)]
        i = bisect_left(breaks, at)
        return breaks[i] if i < len(breaks) else len(self.text)

    def _quoted(self, at: int) -> tuple[str, int] | None:
        """The value of the quoted text that opens at ``at`` and the place after it."""
        if at not in self._quotes:
            quote = self.text[at]
            found = _QUOTED[quote].match(self.text, at)
            self._quotes[at] = (_ESCAPE[quote].sub(lambda m: m[1] or quote, found[1]).strip(), found.end()) if found else None
        return self._quotes[at]

    def _plain(self, at: int, closer: str) -> tuple:
        """The step at a place where no bracketed item stands: quoted, triple or bare."""
        text, sign = self.text, self.text[at]
        if sign in _QUOTED and (whole := self._quoted(at)) and self._ends(whole[1], closer):
            return ("value", (whole[0], False) if whole[0] else None, whole[1])
        if (triple := _TRIPLE.match(text, at)) and self._ends(triple.end(), closer):
            return ("value", (triple[0], False), triple.end())
        end = self._bare_end(at, closer)
        bare = text[at:end]
        value = bare[1:] if sign in _QUOTED else bare
        value = value[:-1] if value.endswith('"') else value
        bad = sign in _QUOTED or any(s in bare for s in "\"[]{}")
        return ("value", (value, bad) if value else None, end)

    def _resolve(self, start: int, closer: str) -> None:
        """Fill ``step`` and ``end`` for the items from ``start``; the contents of brackets are resolved first, on a stack of our own."""
        text, n = self.text, len(self.text)
        stack: list[list] = [[start, closer, []]]  # place, closing sign, places passed
        while stack:
            at, closer, passed = frame = stack[-1]
            known = self.end.get((at, closer))
            if known is None and (at == n or text[at] == closer):
                known = at
                passed.append(at)
            if known is not None:
                for place in passed:
                    self.end[place, closer] = known
                stack.pop()
                continue
            if gap := _GAP.match(text, at):
                step = ("gap", None, gap.end())
            elif text[at] in CLOSERS:
                inner, sign = _BLANKS.match(text, at + 1).end(), CLOSERS[text[at]]
                stop = self.end.get((inner, sign))
                if stop is None:
                    stack.append([inner, sign, []])
                    continue
                filled = stop < n and text[stop] == sign and self._ends(stop + 1, closer)
                step = ("bracket", (inner, sign), stop + 1) if filled else self._plain(at, closer)
            else:
                step = self._plain(at, closer)
            self.step[at, closer] = step
            passed.append(at)
            frame[0] = step[2]

    def values(self, start: int) -> list[Value]:
        self._resolve(start, "")
        out: list[Value] = []
        stack = [(start, "")]
        while stack:
            at, closer = stack.pop()
            while (step := self.step.get((at, closer))) is not None:
                kind, detail, after = step
                if kind == "bracket":  # its contents first, then what follows it
                    stack.append((after, closer))
                    at, closer = detail
                    continue
                if kind == "value" and detail:
                    out.append(detail)
                at = after
        return out


def parse(text: str | None) -> list[Value]:
    """The values of a field in order, each with its error flag (a quote or bracket without partner)."""
    if not text:
        return []
    at = _BLANKS.match(text).end()
    if count := _COUNT.match(text, at):
        at = count.end()
    return _Parser(text).values(at)


def split_packed(rows: DataFrame, key: str, fields: Sequence[str], min_values: int = 1, cache: int = 50_000) -> DataFrame:
    """Rows ``key, field, pos, value, malformed``: one per value of each field, ``pos`` from 1 over the values.

    Rows that repeat a key with the same fields count once; equal values within a field are
    all kept. Null, empty and blank fields have no values; empty places, leading counts
    (``2/A/B``) and brackets are none either; quoted values are unquoted. Only fields with
    ``min_values`` or more values come out. A quote or bracket that is never closed is dropped
    from its value, which is then marked ``malformed``. Other columns of ``rows`` are not read,
    and names in ``fields`` may equal ours. Texts are parsed whole whatever their length; each task
    remembers up to ``cache`` short texts it has parsed.
    """
    names = [f"_f{i}" for i in range(len(fields))]
    once = rows.select(F.col(key).alias("_key"), *[F.col(f).alias(n) for f, n in zip(fields, names)]).distinct()
    long = once.select("_key", F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(n).cast("string").alias("text")) for f, n in zip(fields, names)])))
    long = long.where("text IS NOT NULL AND text <> ''")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        known: dict[str, list[Value]] = {}
        for batch in batches:
            texts = batch.column(2).to_pylist()
            take, pos, value, bad = [], [], [], []
            for i, text in enumerate(texts):
                found = known.get(text)
                if found is None:
                    found = parse(text)
                    if len(text) < 1000:
                        if len(known) >= cache:
                            known.clear()
                        known[text] = found
                if len(found) >= min_values:
                    for p, (v, b) in enumerate(found, 1):
                        take.append(i)
                        pos.append(p)
                        value.append(v)
                        bad.append(b)
            index = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(index), batch.column(1).take(index), pa.array(pos, pa.int32()), pa.array(value, pa.string()), pa.array(bad, pa.bool_())],
                names=["_key", "field", "pos", "value", "malformed"],
            )

    kind = dict(once.dtypes)["_key"]
    parsed = long.mapInArrow(run, f"_key {kind}, field string, pos int, value string, malformed boolean")
    return parsed.select(F.col("_key").alias(key), "field", "pos", "value", "malformed")
