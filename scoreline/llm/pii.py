"""Personal data: expressions propose spans, checksums confirm them, context scores them.

Only DataFrame functions.  A pattern's matches come from ``regexp_extract_all`` and their
places from ``split`` by the same pattern (lengths of the gaps and matches, in code
points).  Patterns are written so that the matcher starts once per run of characters and
never steps back (lookbehinds, possessive repeats): time is linear in the text, and a
match of any length needs no stack.  They find the same matches as the plain forms below.

    email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+
    ip     [0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)      every part at most 255
    card   [0-9]([\\x20-]?[0-9])+                       16 to 19 digits, Luhn
    phone  \\+[0-9][\\x20().0-9-]+[0-9]                 8 to 15 digits
    iban   two letters, two digits, 11 to 30 letters or digits (or groups of four), mod 97

Matches that fail their check are dropped without another try.  A span's score starts at
its kind's value and moves with words of its surroundings.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTEXT_CHARS = 40


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    check: str           # SQL condition on the match ``v``
    needs: str           # a substring that every match has ('' for none)
    score: float
    up: str              # words that raise the score
    down: str            # words that lower it


_BYTE = "0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_DIGITS = "regexp_replace(v, '[^0-9]', '')"
_LUHN = f"""aggregate(sequence(1, length({_DIGITS})), 0, (a, i) -> a +
    CASE WHEN i % 2 = 1 THEN int(substring(reverse({_DIGITS}), i, 1))
         WHEN int(substring(reverse({_DIGITS}), i, 1)) > 4
         THEN 2 * int(substring(reverse({_DIGITS}), i, 1)) - 9
         ELSE 2 * int(substring(reverse({_DIGITS}), i, 1)) END) % 10 = 0"""
_IBAN = "replace(v, ' ', '')"
_MOD97 = f"""length({_IBAN}) BETWEEN 15 AND 34 AND
    aggregate(split(concat(substring({_IBAN}, 5), substring({_IBAN}, 1, 4)), ''), 0, (a, c) ->
        CASE WHEN c = '' THEN a WHEN c BETWEEN '0' AND '9' THEN (a * 10 + int(c)) % 97
             ELSE (a * 100 + ascii(c) - 55) % 97 END) = 1"""

KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
         "true", "@", 0.9, "mail|contact|write to|reach", "example"),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
         rf"v rlike r'^{_BYTE}(\.{_BYTE}){{3}}$'", ".", 0.6,
         r"\bip\b|address|server|host|login", "version|release|section"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9]){15,}+",
         f"length({_DIGITS}) BETWEEN 16 AND 19 AND {_LUHN}", "", 0.85,
         "card|visa|credit|payment|pay", "order|tracking|serial"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]",
         f"length({_DIGITS}) BETWEEN 8 AND 15", "+", 0.7,
         "phone|call|tel|mobile|fax", "version|score|isbn"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
         _MOD97, "", 0.9, "iban|account|bank|transfer", "serial|tracking"),
)
BASE = tuple(k.name for k in KINDS[:4])
_SPAN = "array<struct<s:bigint,e:bigint,v:string>>"
CHUNK = 256          # values whose running total is built in one go
SEGMENT = 1024       # characters of a segment of the text


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _running(values: str, step: str) -> str:
    """For each value the result of ``step`` (on ``b.at`` and ``x``, from 0) over those before
    it.  Chunk by chunk, so that no long list is copied for every value."""
    inner = f"""aggregate(c, struct(a.at AS at, cast(array() AS array<bigint>) AS got),
        (b, x) -> struct({step} AS at, concat(b.got, array(b.at)) AS got))"""
    chunks = (f"transform(sequence(0, (size({values}) - 1) div {CHUNK}), "
              f"i -> slice({values}, int(i * {CHUNK} + 1), {CHUNK}))")
    return f"""flatten(aggregate({chunks}, struct(0L AS at, cast(array() AS array<array<bigint>>) AS got),
        (a, c) -> {_let(inner, 'r', 'struct(r.at AS at, concat(a.got, array(r.got)) AS got)')},
        a -> a.got))"""


def _piece(begin: str, end: str) -> str:
    """Characters [begin, end) of the text from its segments: the cost is the piece's, not
    that of the text before it."""
    seg = f"get(segments, int({{}} div {SEGMENT}))"
    first, last = seg.format(begin), seg.format(end)
    return f"""CASE WHEN {begin} div {SEGMENT} = {end} div {SEGMENT}
        THEN coalesce(substring({first}, int({begin} % {SEGMENT}) + 1, int({end} - {begin})), '')
        ELSE concat(substring({first}, int({begin} % {SEGMENT}) + 1),
                    array_join(slice(segments, int({begin} div {SEGMENT}) + 2,
                                     int({end} div {SEGMENT} - {begin} div {SEGMENT}) - 1), ''),
                    coalesce(substring({last}, 1, int({end} % {SEGMENT})), '')) END"""


def _lengths(kind: Kind) -> Column:
    """Characters of each match and of the gap before it."""
    pattern = kind.pattern.replace("'", "\\'")
    hits = f"hit_{kind.name}"
    return F.expr(f"""CASE WHEN size({hits}) = 0 THEN cast(array() AS array<bigint>) ELSE
        zip_with(slice(split(text, r'{pattern}', -1), 1, size({hits})), {hits},
                 (g, v) -> bigint(length(g) + length(v))) END""")


def _spans(kind: Kind) -> Column:
    """Confirmed spans of one kind."""
    hits, size = f"hit_{kind.name}", f"len_{kind.name}"
    return F.expr(f"""
      CASE WHEN size({hits}) = 0 THEN cast(array() AS {_SPAN}) ELSE
      filter(zip_with(zip_with({size}, {_running(size, 'b.at + x')}, (n, at) -> at + n), {hits},
                      (e, v) -> struct(e - length(v) AS s, e AS e, v AS v)),
             x -> exists(array(x.v), v -> {kind.check})) END""")


def _scored(kind: Kind) -> Column:
    """Spans with kind and score; context is the text around the span, in lower case."""
    before, after = f"greatest(x.s - {CONTEXT_CHARS}, 0L)", f"least(x.e + {CONTEXT_CHARS}, size_)"
    around = f"lower(concat({_piece(before, 'x.s')}, ' ', {_piece('x.e', after)}))"
    score = (f"least(1D, greatest(0D, {kind.score}D + CASE WHEN t rlike r'{kind.up}' THEN 0.1D "
             f"ELSE 0D END - CASE WHEN t rlike r'{kind.down}' THEN 0.2D ELSE 0D END))")
    return F.expr(f"transform(found_{kind.name}, x -> struct('{kind.name}' AS kind, x.s AS start, "
                  f"x.e AS end, {_let(around, 't', score)} AS score))")


def _found(docs: DataFrame, text_col: str) -> DataFrame:
    """(row, text, segments, spans): the whole row as one value, so no name can clash."""
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                     F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    df = df.withColumns({f"hit_{k.name}": F.when(
        F.contains("text", F.lit(k.needs)) if k.needs else F.lit(True),
        F.regexp_extract_all("text", F.lit(k.pattern), F.lit(0))).otherwise(
            F.expr("cast(array() AS array<string>)")) for k in KINDS})
    df = df.withColumns({f"len_{k.name}": _lengths(k) for k in KINDS})
    df = df.withColumns({f"found_{k.name}": _spans(k) for k in KINDS})
    some = " + ".join(f"size(found_{k.name})" for k in KINDS)
    df = df.withColumns({
        "size_": F.length("text").cast("long"),
        "segments": F.expr(f"CASE WHEN {some} > 0 THEN regexp_extract_all(text, "
                           f"r'(?s).{{1,{SEGMENT}}}', 0) ELSE cast(array() AS array<string>) END")})
    return df.select("row", "text", "segments", "size_",
                     F.concat(*[_scored(k) for k in KINDS]).alias("spans"))


def find(docs: DataFrame, text_col: str = "text", out: str = "pii") -> DataFrame:
    """``docs`` plus the column ``out``: all spans (kind, start, end, score), by kind as
    listed in ``KINDS``, then start.

    Null and empty texts have no spans.  Spans of different kinds may overlap.  Rows are
    neither dropped nor merged; other columns pass through whatever their names (a column
    named ``out`` is replaced).  The time is proportional to the text, however many matches
    it has.
    """
    return _found(docs, text_col).select(
        *[F.col("row").getField(c).alias(c) for c in docs.columns if c != out],
        F.col("spans").alias(out))


def digest(df: DataFrame, spans: str = "pii") -> DataFrame:
    """Contract columns from the spans."""
    code = f"concat_ws(',', transform({{}}, x -> concat(x.kind, ':', x.start, ':', x.end)))"
    base = f"filter({spans}, x -> x.kind IN ({', '.join(repr(k) for k in BASE)}))"
    return df.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *[F.expr(f"bigint(size(filter({spans}, x -> x.kind = '{k}')))").alias(f"n_{k}") for k in BASE],
        F.sha2(F.expr(code.format(base)), 256).alias("base_sha256"),
        F.expr(code.format(spans)).alias("spans"),
        F.coalesce(F.array_max(F.expr(f"transform({spans}, x -> x.score)")), F.lit(0.0)).alias("max_score"))


def mask(docs: DataFrame, text_col: str = "text", min_score: float = 0.3,
         size_col: str | None = None) -> DataFrame:
    """``docs`` with every span of at least ``min_score`` replaced by its kind in brackets.

    Overlapping spans are replaced together, under the kind of the first.  Null texts stay
    null; all rows and columns are kept, whatever their names; ``size_col`` follows the new
    length where the text changes.
    """
    df = _found(docs, text_col).withColumn("spans", F.expr(
        f"array_sort(transform(filter(spans, x -> x.score >= {min_score}D), "
        "x -> struct(x.start AS s, x.end AS e, x.kind AS kind)))"))
    # spans that begin where all before them have ended start a stretch
    df = df.withColumn("ends", F.expr("transform(spans, x -> x.e)"))
    df = df.withColumn("before", F.expr(
        f"CASE WHEN size(ends) = 0 THEN ends ELSE {_running('ends', 'greatest(b.at, x)')} END"))
    df = df.withColumn("heads", F.expr(
        "filter(sequence(0, size(spans)), i -> i = size(spans) OR get(spans, i).s >= get(before, i))"))
    # [start, end) of each stretch: it ends where the spans up to the next one have ended
    df = df.withColumn("cuts", F.expr("""
        transform(slice(heads, 1, size(heads) - 1), (h, i) -> struct(
            get(spans, h).s AS s, get(spans, h).kind AS kind,
            CASE WHEN get(heads, i + 1) = size(spans)
                 THEN greatest(get(before, size(spans) - 1), get(ends, size(spans) - 1))
                 ELSE get(before, get(heads, i + 1)) END AS e))"""))
    gap = _piece("CASE WHEN i = 0 THEN 0L ELSE get(cuts, i - 1).e END", "x.s")
    tail = _piece("get(cuts, size(cuts) - 1).e", "size_")
    df = df.withColumn("masked", F.expr(f"""
        concat(array_join(transform(cuts, (x, i) -> concat({gap}, '[', upper(x.kind), ']')), ''), {tail})"""))
    old = F.col("row").getField(text_col)
    hit = F.size("spans") > 0
    new = {text_col: F.when(hit, F.col("masked")).otherwise(old.cast("string"))}
    if size_col:
        changed = hit & (F.col("masked") != F.col("text"))
        new[size_col] = F.when(changed, F.length("masked").cast("long")).otherwise(
            F.col("row").getField(size_col))
    return df.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
