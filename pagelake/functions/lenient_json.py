"""Reading model replies: find the JSON in free text, then coerce its values. All Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelake.functions.text import as_col, empty_to_null, let, strip


def _checked(text: Column) -> Column:
    """Struct (text, value) when the text is exactly one JSON value, else NULL.

    The parser stops after the first value and ignores what follows, so the text is parsed with a
    known element behind it, inside an array; its first item is the value. A text that closes that
    array itself has a ``]``; only then is it parsed a second time, inside an object. No text can end both early.
    """

    def check(in_array: Column) -> Column:
        one = F.try_variant_get(in_array, "$[1]", "variant").isNotNull() & F.try_variant_get(in_array, "$[2]", "variant").isNull()
        in_object = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit(',"w":0}')))
        whole = ~F.contains(text, F.lit("]")) | F.try_variant_get(in_object, "$.w", "variant").isNotNull()
        return F.when(one & whole, F.struct(text.alias("text"), F.try_variant_get(in_array, "$[0]", "variant").alias("value")))

    return let(F.try_parse_json(F.concat(F.lit("["), text, F.lit(",0]"))), check)


def _found(reply: Column | str) -> Column:
    """The JSON of a reply as (text, value): the whole, one code fence, or the widest ``{...}`` / ``[...]``; else NULL."""
    content = strip(reply)
    fence = r"(?is)^```(?:json)?(?U)\s*(.*?)\s*```$"
    inner = F.when(content.rlike(fence), strip(F.regexp_extract(content, fence, 1))).otherwise(content)

    def search(text: Column) -> Column:
        braces = empty_to_null(F.regexp_extract(text, r"(?s)^[^{]*(\{.*\})", 1))
        brackets = empty_to_null(F.regexp_extract(text, r"(?s)^[^\[]*(\[.*\])", 1))
        return F.coalesce(_checked(text), let(F.coalesce(braces, brackets), _checked))

    return let(inner, search)


def _empty_object() -> Column:
    return F.struct(F.lit("{}").alias("text"), F.parse_json(F.lit("{}")).alias("value"))


def json_payload(reply: Column | str) -> Column:
    """JSON text found in a reply; ``{}`` when there is none; NULL stays NULL (no reply at all)."""
    return F.when(as_col(reply).isNotNull(), let(_found(reply), lambda f: F.coalesce(f.text, F.lit("{}"))))


def json_object(reply: Column | str) -> Column:
    """The object in a reply, parsed once: (text, value); an empty one for anything else, or for no reply.

    The functions below read its members. The text serves those that keep keys in written order.
    """
    return let(_found(reply), lambda f: F.when(f.text.rlike(r"^\s*\{"), f).otherwise(_empty_object()))


def member(payload: Column, key: str) -> Column:
    """Variant value of a key: SQL NULL when absent, variant null for a JSON null."""
    return F.try_variant_get(payload.value, f"$.{key}", "variant")


def member_object(payload: Column, key: str) -> Column:
    """A member as an object of its own; (NULL, NULL) when absent."""
    return F.struct(F.get_json_object(payload.text, f"$.{key}").alias("text"), member(payload, key).alias("value"))


def kind_of(value: Column) -> Column:
    """string, number, boolean, null, array or object."""
    return let(
        F.schema_of_variant(value),
        lambda schema: F.when(schema == "STRING", "string")
        .when(schema == "BOOLEAN", "boolean")
        .when(schema == "VOID", "null")
        .when(schema.startswith("ARRAY"), "array")
        .when(schema.startswith("OBJECT"), "object")
        .when(schema.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), "number"),
    )


def text_of(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def string_value(value: Column) -> Column:
    """The text of a JSON string, NULL for anything else."""
    return F.when(kind_of(value) == "string", text_of(value))


def string_list(value: Column) -> Column:
    """Trimmed, non-empty string items of a JSON array; empty for anything else."""
    items = F.try_variant_get(value, "$", "array<variant>")
    texts = F.transform(F.filter(items, lambda v: kind_of(v) == "string"), lambda v: strip(text_of(v)))
    return F.coalesce(F.filter(texts, lambda t: t != ""), F.array().cast("array<string>"))


def _member_map(payload: Column, key: str) -> Column:
    """An object member as map<string,string> with its keys in written order; NULL for anything else. One parse reads it alone."""
    return F.from_json(payload.text, f"struct<`{key}`:map<string,string>>")[key]


def string_map(payload: Column, key: str) -> Column:
    """Member object as map<string,string>: scalars trimmed, nested values as JSON, nulls dropped."""
    kept = F.map_filter(_member_map(payload, key), lambda _, v: v.isNotNull())
    trimmed = F.transform_values(kept, lambda _, v: strip(v))
    return F.coalesce(trimmed, F.create_map().cast("map<string,string>"))


def _read(value: Column, body) -> Column:
    """Hand (value, kind, text), each computed once, to ``body``."""
    return let(F.struct(value.alias("value"), kind_of(value).alias("kind"), text_of(value).alias("text")), lambda r: body(r["value"], r.kind, r.text))


def _whole_number(value: Column) -> Column:
    """Integer reading of a variant: integer text, truncated number or boolean; else NULL."""

    def whole(value: Column, kind: Column, text: Column) -> Column:
        digits = F.when(text.rlike(r"(?U)^\s*[+-]?\d+\s*$"), F.translate(strip(text), "０１２３４５６７８９", "0123456789"))
        return (
            F.when(kind == "string", digits.try_cast("int"))
            .when(kind == "number", F.try_variant_get(value, "$", "double").try_cast("int"))
            .when(kind == "boolean", F.try_variant_get(value, "$", "boolean").cast("int"))
        )

    return _read(value, whole)


def int_map(payload: Column, key: str) -> Column:
    """Member object as map<string,int>; unreadable and negative values dropped."""
    order = F.map_keys(_member_map(payload, key))

    def entries(values: Column) -> Column:
        read = F.transform(order, lambda k: F.struct(k.alias("key"), _whole_number(F.try_element_at(values, k)).alias("value")))
        return F.map_from_entries(F.filter(read, lambda e: e["value"] >= 0))

    found = let(F.try_variant_get(member(payload, key), "$", "map<string,variant>"), entries)
    return F.coalesce(found, F.create_map().cast("map<string,int>"))


def boolean_value(value: Column) -> Column:
    """true, 1/true/yes text and non-zero numbers are true; NULL only for an absent key."""
    return _read(value, lambda value, kind, text: F.when(value.isNotNull(), F.coalesce(
        F.when(kind == "boolean", F.try_variant_get(value, "$", "boolean"))
        .when(kind == "string", F.lower(strip(text)).isin("1", "true", "yes"))
        .when(kind == "number", F.try_variant_get(value, "$", "double") != 0),
        F.lit(False),
    )))


def natural_int(value: Column) -> Column:
    """Integer of at least zero; unreadable values are zero; NULL only for an absent key."""
    return let(value, lambda v: F.when(v.isNotNull(), F.greatest(F.lit(0), F.coalesce(_whole_number(v), F.lit(0)))))


def unit_float(value: Column) -> Column:
    """Number clamped to [0, 1]; unreadable values and NaN are 0.0."""

    def number(value: Column, kind: Column, text: Column) -> Column:
        return (
            F.when(kind == "string", strip(text).try_cast("double"))
            .when(kind == "number", F.try_variant_get(value, "$", "double"))
            .when(kind == "boolean", F.try_variant_get(value, "$", "boolean").cast("double"))
        )

    usable = let(_read(value, number), lambda n: F.when(~F.isnan(n), n))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(usable, F.lit(0.0))))
