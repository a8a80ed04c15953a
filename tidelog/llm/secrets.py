"""Secret scans with multipart credential linking, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in the order that breaks ties of start. The first three are found anywhere; the others are
#: weak candidates.
KINDS = ("assign", "access", "hex", "id", "key", "endpoint")
BASE = KINDS[:3]
#: One match of each pattern at the place where a run of it begins. A bounded run such as [0-9a-f]{24,}
#: finds what the open one finds and then drops for its length; assign cannot be bounded that way, since
#: a short match uses up its characters.
PATTERNS = {
    "assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"(?<![0-9a-f])[0-9a-f]{24,}",
    "id": r"""(?i)(?:client|account|user|access_?key)_?(?:id|name)["']?\x20*[:=]\x20*["']?[a-z0-9_.@-]{4,}""",
    "key": r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}={0,2}",
    "endpoint": r"(?i)https?://[a-z0-9.-]+(?::[0-9]+)?(?:/[a-z0-9._~/%-]*)?",
}
LEAST_ASSIGNED = 6
#: Characters between the parts of one credential.
SCOPE = 200
MARK = "[SECRET]"
_SPAN = "struct<start:bigint,nr:int,kind:string,end:bigint,byte:bigint,byte_end:bigint>"
#: Steps of a running value that are taken one by one before blocks of them are joined.
BLOCK = 64


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often and deep inside it is used."""
    return F.transform(F.array(value), body)[0]


def _running(items: Column, value: Callable[[Column], Column], join: Callable[[Column, Column], Column], kind: str) -> Column:
    """The values of an array joined from its start up to each place, as an array.

    Appending to an array copies it, so values are joined within blocks, then over the blocks' ends: of n items n times
    BLOCK and the square of n / BLOCK values are copied. ``join`` is associative and takes null as nothing.
    """

    def joined(xs: Column, of: Callable[[Column], Column]) -> Column:
        none = F.struct(F.array().cast(f"array<{kind}>").alias("out"), F.lit(None).cast(kind).alias("now"))

        def step(state: Column, x: Column) -> Column:
            return _let(join(state["now"], of(x)), lambda now: F.struct(F.concat(state["out"], F.array(now)).alias("out"), now.alias("now")))

        return F.aggregate(xs, none, step, lambda s: s["out"])

    def over(items: Column) -> Column:
        n = F.ceil(F.size(items) / BLOCK).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), n - 1), lambda i: joined(F.slice(items, i * BLOCK + 1, BLOCK), value))

        def with_ends(blocks: Column) -> Column:
            ends = joined(blocks, lambda b: F.element_at(b, -1))
            # what came before a block: the end of the one before it
            return _let(ends, lambda e: F.flatten(F.transform(blocks, lambda b, i: F.transform(b, lambda x: F.when(i > 0, join(F.get(e, i - 1), x)).otherwise(x)))))

        return F.when(F.size(items) > 0, _let(blocks, with_ends)).otherwise(F.array().cast(f"array<{kind}>"))

    return _let(items, over)


def _found(text: Column, kind: str) -> Column:
    """Spans of a kind in order, each as (start, nr, kind, end, byte, byte_end)."""
    pattern = PATTERNS[kind]
    nr = KINDS.index(kind) + 1

    def placed(found: Column) -> Column:
        pieces = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        parts = F.zip_with(found, pieces, lambda f, p: F.struct(f.alias("f"), F.char_length(f).alias("n"), F.octet_length(f).alias("b"), F.char_length(p).alias("gap"), F.octet_length(p).alias("bytes")))

        def spans(parts: Column) -> Column:
            step = lambda x: F.struct((x["gap"] + x["n"]).alias("at"), (x["bytes"] + x["b"]).alias("byte"))
            join = lambda x, y: F.struct((F.coalesce(x["at"], F.lit(0)) + y["at"]).alias("at"), (F.coalesce(x["byte"], F.lit(0)) + y["byte"]).alias("byte"))
            ends = _running(parts, step, join, "struct<at:int,byte:int>")
            whole = lambda x, e: F.struct(
                (e["at"] - x["n"]).cast("long").alias("start"), F.lit(nr).alias("nr"), F.lit(kind).alias("kind"), e["at"].cast("long").alias("end"),
                (e["byte"] - x["b"]).cast("long").alias("byte"), e["byte"].cast("long").alias("byte_end"), x["f"].alias("f"),
            )
            out = F.zip_with(parts, ends, whole)
            if kind == "assign":
                out = F.filter(out, lambda s: F.char_length(F.regexp_extract(s["f"], pattern, 2)) >= LEAST_ASSIGNED)
            if kind == "key":
                out = F.filter(out, lambda s: s["f"].rlike("[a-z]") & s["f"].rlike("[A-Z]") & s["f"].rlike("[0-9]"))
            return F.transform(out, lambda s: F.struct(*(s[c].alias(c) for c in ("start", "nr", "kind", "end", "byte", "byte_end"))))

        return _let(parts, spans)

    none = F.array().cast(f"array<{_SPAN}>")
    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, placed(found)).otherwise(none))


def _linked(spans: Column, scope: int) -> Column:
    """Without the weak candidates that lack their complement in scope.

    The interval join is a sweep: whether a part lies within ``scope`` characters before or after is told by
    the furthest end so far and, from the other side, the nearest start, so a document with many
    parts costs a sort and never their pairs.
    """
    roles = {"b": lambda s: s["nr"] <= len(BASE), "i": lambda s: s["kind"].isin("access", "id"), "s": lambda s: s["kind"].isin("assign", "hex", "key")}
    kind = "struct<b:bigint,i:bigint,s:bigint>"

    def marks(side: str) -> Callable[[Column], Column]:
        return lambda s: F.struct(*(F.when(has(s), s[side]).alias(r) for r, has in roles.items()))

    def furthest(x: Column, y: Column) -> Column:
        return F.struct(*(F.greatest(x[r], y[r]).alias(r) for r in roles))

    def nearest(x: Column, y: Column) -> Column:
        return F.struct(*(F.least(x[r], y[r]).alias(r) for r in roles))

    def kept(spans: Column) -> Column:
        before = _running(spans, marks("end"), furthest, kind)
        after = F.reverse(_running(F.reverse(spans), marks("start"), nearest, kind))

        def judged(before: Column, after: Column) -> Column:
            def stays(s: Column, i: Column) -> Column:
                x, y = F.get(before, i - 1), F.get(after, i + 1)

                def within(r: str, d: int) -> Column:
                    return F.coalesce(s["start"] - x[r] <= d, F.lit(False)) | F.coalesce(y[r] - s["end"] <= d, F.lit(False))

                weak = F.when(s["kind"] == "id", within("s", scope)).when(s["kind"] == "key", within("i", scope)).otherwise(within("i", scope) & within("s", scope))
                return (s["nr"] <= len(BASE)) | (~within("b", -1) & weak)

            return F.filter(spans, stays)

        return _let(before, lambda b: _let(after, lambda a: judged(b, a)))

    # a text of base spans alone has nothing to link
    return _let(spans, lambda s: F.when(F.exists(s, lambda x: x["nr"] > len(BASE)), kept(s)).otherwise(s))


def secret_spans(text: Column, scope: int = SCOPE) -> Column:
    """The spans of a text, an array of (start, nr, kind, end, byte, byte_end) by start, then kind."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return _linked(F.sort_array(F.concat(*(_found(text, k) for k in KINDS))), scope)


def find_secrets(docs: DataFrame, text_col: str = "text", scope: int = SCOPE, carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` of ``docs`` (all by default) as a struct ``doc``, and ``spans``: one row per row.

    ``spans`` is an array of (start, nr, kind, end, byte, byte_end) by start, then kind: places in code points and in bytes
    of the UTF-8 text. Base kinds are reported wherever they stand. Weak ones do not overlap a base one and need their
    complement within ``scope`` characters: an identifier a secret, a secret an identifier, an endpoint both. All is done
    within each row, with no exchange. Cases: null text is empty; a very long text with many parts costs a sort of them;
    null and repeated ids are rows of their own; an empty table gives no rows; only ``text_col`` is read, further columns
    are carried whatever their names.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in carry or docs.columns]).alias("doc")
    return docs.select(whole, secret_spans(F.col(f"`{text_col}`"), scope).alias("spans"))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = MARK) -> Column:
    """The text with ``mark`` for each span; spans that meet are one. Linear in the text and its spans."""
    furthest = lambda x, y: F.greatest(x, y)

    def cut(spans: Column, ends: Column, raw: Column) -> Column:
        part = lambda a, b: F.substring(raw, (a + 1).cast("int"), (b - a).cast("int")).cast("string")
        before = F.transform(spans, lambda s, i: F.struct(s["byte"].alias("byte"), F.get(ends, i - 1).alias("done")))
        first = F.filter(before, lambda s: s["done"].isNull() | (s["byte"] > s["done"]))
        pieces = F.transform(first, lambda s: F.concat(part(F.coalesce(s["done"], F.lit(0).cast("long")), s["byte"]), F.lit(mark)))
        return F.concat(F.array_join(pieces, ""), part(F.element_at(ends, -1), F.length(raw)))

    ends = _running(spans, lambda s: s["byte_end"], furthest, "bigint")
    return _let(spans, lambda s: _let(ends, lambda e: _let(text.cast("binary"), lambda raw: cut(s, e, raw))))


def redact_secrets(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars", scope: int = SCOPE, mark: str = MARK) -> DataFrame:
    """``docs`` with every span replaced by ``mark`` (spans that meet by one) and ``chars_col`` set anew there.

    Rows stay where they are: nothing is exchanged. Cases: a null text stays null and an empty one empty; a very long text with
    many spans is cut in one pass over both; repeated rows and null ids are rows of their own; an empty table gives no rows;
    further columns pass through, whatever their names.
    """
    names = docs.columns
    found = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], secret_spans(F.col(f"`{text_col}`"), scope).alias("spans"))
    text = F.col(f"c{names.index(text_col)}")
    found = found.withColumn("redacted", F.when(F.size("spans") > 0, redacted(text.cast("string"), F.col("spans"), mark)).otherwise(text))
    out = []
    for i, c in enumerate(names):
        value = F.col("redacted") if c == text_col else F.col(f"c{i}")
        if c == chars_col:
            value = F.when(F.size("spans") > 0, F.char_length("redacted").cast(docs.schema[c].dataType)).otherwise(value)
        out.append(value.alias(c))
    return found.select(out)
