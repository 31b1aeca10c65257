"""Personal data in texts, found and masked with SQL functions alone."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements of an array that are walked together; see _before().
CHUNK = 64

_IN_EMAIL = "[A-Za-z0-9._%+-]"


class Kind(NamedTuple):
    """A kind of span: its pattern, what confirms a match, its score and the words that raise it."""

    name: str
    pattern: str
    confirm: Callable[[Column], Column] | None
    score: float
    near: str
    base: bool


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _small_parts(m: Column) -> Column:
    return m.rlike(r"^(0*+(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9]|)(\.|$))+$")


def luhn(m: Column) -> Column:
    """13 to 19 digits whose Luhn sum is divisible by 10."""
    d = F.reverse(_digits(m))
    n = F.length(d)

    def add(total: Column, i: Column) -> Column:
        x = F.substring(d, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(x > 9, x - 9).otherwise(x)

    return n.between(13, 19) & (F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(n, F.lit(19)), F.lit(1))), F.lit(0), add) % 10 == 0)


def _phone_digits(m: Column) -> Column:
    return F.length(_digits(m)).between(9, 15)


def mod97(m: Column) -> Column:
    """An IBAN's check: the country and check digits moved to the end, letters as 10 to 35, leave 1 modulo 97."""
    x = F.replace(m, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(x, 5, 40), F.substring(x, 1, 4))

    def add(rest: Column, i: Column) -> Column:
        c = F.substring(moved, i, F.lit(1))
        return F.when(c.between("0", "9"), (rest * 10 + F.ascii(c) - 48) % 97).otherwise((rest * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), add) == 1


def _mixed(m: Column) -> Column:
    """Letters and digits both, as keys and tokens have and words don't."""
    return m.rlike("[A-Za-z]") & m.rlike("[0-9]")


#: In the order of the result. The base kinds' patterns find what the plain ones
#: in the comments find, in linear time: a match can only begin where the last one
#: ended (\G) or where a run of its first class begins, and possessive repeats
#: neither try shorter runs nor use the stack.
KINDS = (
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    Kind("email", rf"(?:\G|(?<!{_IN_EMAIL})){_IN_EMAIL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", None, 0.9, "mail|contact|write", True),
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", _small_parts, 0.6, r"\bip\b|host|server|address", True),
    # [0-9]([\x20-]?[0-9])+
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", luhn, 0.8, "card|visa|pay", True),
    # \+[0-9][\x20().0-9-]+[0-9]
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", _phone_digits, 0.6, "phone|call|tel|fax|mobile", True),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])", mod97, 0.9, "iban|account|bank", False),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", None, 0.4, r"\bssn\b|social security|tax id", False),
    # A run of 20 characters or more counts only beside a word that says what it is.
    Kind("secret", r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+", _mixed, 0.4, "token|secret|passw|api.?key|access.?key|credential|bearer", False),
)
AGAINST = "example|order|invoice|version|part no|serial"
BASE = tuple(k.name for k in KINDS if k.base)


def _chunks(values: Column) -> Column:
    """An array's elements in arrays of CHUNK; none of an empty or null one."""
    starts = F.when(F.size(values) > 0, F.sequence(F.lit(0), F.size(values) - 1, F.lit(CHUNK))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda at: F.slice(values, at + 1, CHUNK))


def _before(chunks: Column, add: Callable[[Column, Column], Column]) -> Column:
    """For each whole number of chunks, those before it, put together by `add`; 0 for the first.

    Arrays can only grow by being copied, so they grow in chunks of CHUNK.
    """
    zero = F.lit(0).cast("long")
    grow = lambda acc, x: F.concat(acc, F.array(add(F.element_at(acc, -1), x)))
    totals = F.transform(chunks, lambda c: F.aggregate(c, zero, add))
    starts = F.aggregate(totals, F.array(zero), grow)
    inner = F.zip_with(chunks, F.slice(starts, F.lit(1), F.size(chunks)), lambda c, at: F.slice(F.aggregate(c, F.array(at), grow), F.lit(1), F.size(c)))
    return F.flatten(inner)


def find_pii(docs: DataFrame, text: str = "text", least: float = 0.5, out: str = "pii") -> DataFrame:
    """docs with a column pii (or named by `out`): array<struct<kind, start, end, score>>, by kind, then start.

    Offsets are code points, the end exclusive. Patterns propose spans, leftmost
    and not overlapping within a kind; checksums (Luhn, modulo 97) and digit
    counts confirm them; a word of the kind within 40 characters before or 20 after
    raises the score by 0.2, one of AGAINST before it lowers it by 0.2. Spans of the base kinds stay whatever their
    score, those of other kinds from `least` on. Null and empty texts give an
    empty array; every row stays, repeated ones too; a column named as `out` is
    replaced, other columns pass through. Nothing is shuffled.

    A kind's matches and the pieces between them come from one pattern, so the
    places are running sums of their lengths, in one pass over the text.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != out]).alias("row"))
    rows = rows.withColumn("text", F.coalesce(F.col(f"row.`{text}`").cast("string"), F.lit("")))
    rows = rows.withColumns({f"m_{k.name}": F.regexp_extract_all("text", F.lit(k.pattern), F.lit(0)) for k in KINDS})
    rows = rows.withColumns(
        {f"p_{k.name}": F.when(F.size(f"m_{k.name}") > 0, F.split("text", k.pattern, -1)) for k in KINDS}
    )
    # Each step is a column of its own, so that what later steps use twice is made once.
    rows = rows.withColumns({f"l_{k.name}": _looked(k, least) for k in KINDS})
    rows = rows.withColumns({f"c_{k.name}": _chunks(F.transform(f"l_{k.name}", lambda x: x["gap"] + x["size"])) for k in KINDS})
    rows = rows.withColumns({k.name: _spans(k) for k in KINDS})
    return rows.select("row.*", F.concat(*[F.col(k.name) for k in KINDS]).alias(out))


def _looked(kind: Kind, least: float) -> Column:
    """Of each match the distance to the one before, its length, whether it counts, and its score."""
    matches, pieces = F.col(f"m_{kind.name}"), F.col(f"p_{kind.name}")

    def look(m: Column, i: Column) -> Column:
        before, after = F.get(pieces, i), F.get(pieces, i + 1)
        ahead = F.lower(F.right(before, F.lit(40)))
        around = F.concat(ahead, F.lit(" "), F.lower(F.substring(after, 1, 20)))
        score = F.lit(kind.score) + F.when(around.rlike(kind.near), 0.2).otherwise(0.0) - F.when(ahead.rlike(AGAINST), 0.2).otherwise(0.0)
        score = F.round(F.least(F.lit(1.0), score), 2)
        good = kind.confirm(m) if kind.confirm else F.lit(True)
        return F.struct(
            F.length(before).cast("long").alias("gap"),
            F.length(m).cast("long").alias("size"),
            (good if kind.base else good & (score >= least)).alias("good"),
            score.alias("score"),
        )

    return F.when(F.size(matches) > 0, F.transform(matches, look))


def _spans(kind: Kind) -> Column:
    empty = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,score:double>>")
    looked = F.col(f"l_{kind.name}")

    def span(x: Column, at: Column) -> Column:
        start = at + x["gap"]
        end = start + x["size"]
        return F.struct(F.lit(kind.name).alias("kind"), start.alias("start"), end.alias("end"), x["score"].alias("score"), x["good"].alias("good"))

    found = F.filter(F.zip_with(looked, _before(F.col(f"c_{kind.name}"), lambda a, b: a + b), span), lambda x: x["good"])
    found = F.transform(found, lambda x: F.struct(*[x[c].alias(c) for c in ("kind", "start", "end", "score")]))
    return F.when(looked.isNotNull(), found).otherwise(empty)


def told(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def mask_pii(found: DataFrame, text: str = "text", pii: str = "pii") -> DataFrame:
    """Replace the spans of find_pii() by <KIND>; overlapping spans become one mark, of the one that begins first, the longer one of those.

    The column of spans is dropped. Null texts stay null.
    """
    spans = F.array_sort(F.transform(F.col(pii), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("till"), s["kind"].alias("kind"))))
    columns = [c for c in found.columns if c != pii]
    rows = found.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.when(F.size(pii) > 0, spans).alias("spans"))
    body = F.col(f"row.`{text}`")
    rows = rows.withColumn("ends", _chunks(F.transform("spans", lambda s: -s["till"])))
    # A span that begins before all earlier ones have ended lies in their mark.
    done = _before(F.col("ends"), lambda a, b: F.greatest(a, b))
    marks = F.zip_with("spans", done, lambda s, at: F.struct(at.alias("at"), s["start"].alias("start"), s["kind"].alias("kind")))
    rows = rows.withColumn("marks", F.filter(marks, lambda m: m["start"] >= m["at"]))

    def cut(text: Column, start: Column, end: Column) -> Column:
        return F.substring(text, (start + 1).cast("int"), (end - start).cast("int"))

    def masked(chunk: Column) -> Column:
        """A chunk's marks, each behind the text before it, which is cut from the chunk's part of the whole."""
        first = F.get(chunk, F.lit(0))["at"]
        part = cut(body, first, F.element_at(chunk, -1)["start"])
        piece = lambda m: F.concat(cut(part, m["at"] - first, m["start"] - first), F.lit("<"), F.upper(m["kind"]), F.lit(">"))
        return F.array_join(F.transform(chunk, piece), "")

    last = F.array_max(F.transform("spans", lambda s: -s["till"]))
    whole = F.concat(F.array_join(F.transform(_chunks(F.col("marks")), masked), ""), F.substring(body, (last + 1).cast("int"), F.length(body)))
    whole = F.when(F.col("spans").isNotNull(), whole).otherwise(body)
    return rows.select(*[whole.alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in columns])
