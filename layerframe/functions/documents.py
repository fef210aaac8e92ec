"""JSON documents held as text: rendering, keys and soft-failing overlay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from layerframe.functions.maps import last_wins, overlay_maps

_OBJECT = T.MapType(T.StringType(), T.VariantType())
_KEEP_NULLS = {"ignoreNullFields": "false"}
_JSON_SPACE = " \t\n\r"


def render_doc(*cols: Column | str) -> Column:
    """One JSON object per row; strings are escaped and NULL fields are kept."""
    return F.to_json(F.struct(*cols), _KEEP_NULLS)


def object_keys(text: Column) -> Column:
    """Distinct keys of a JSON object; NULL for anything else."""
    return F.array_distinct(F.json_object_keys(text))


def with_object(df: DataFrame, name: str, text: Column) -> DataFrame:
    """Add the top level of a JSON object as a map from key to variant.

    NULL for anything that is not an object. Of a repeated key the last one
    counts, of several documents in a row the first. An object further inside
    that repeats a key makes the whole text count as broken.
    """
    # In two steps, so that each text is parsed once.
    return df.withColumn(name, F.from_json(text, _OBJECT)).withColumn(
        name, last_wins(F.col(name))
    )


def with_member(df: DataFrame, name: str, text: Column, field: str) -> DataFrame:
    """Add the object in a ``field`` of a JSON object, as :func:`with_object`."""
    return df.withColumn(
        name, F.from_json(text, T.StructType().add(field, _OBJECT))[field]
    ).withColumn(name, last_wins(F.col(name)))


def overlay_json(
    df: DataFrame,
    base: Column,
    extra: Column,
    field: str | None = None,
    doc: str = "doc",
    status: str = "status",
) -> DataFrame:
    """Overlay the keys of JSON object ``extra`` on those of ``base``.

    With ``field``, the objects in that field of the two documents are
    overlaid and the rest of ``base`` is kept. Adds two columns:

    * ``doc``: the merged text, or the base document alone if there is
      nothing to merge or ``extra`` is broken; NULL if ``base`` is no object.
      Objects inside come out with sorted keys
    * ``status``: ``absent`` (NULL extra), ``empty`` (blank text, ``null`` or
      ``false``, or such a field), ``merged``, or ``invalid`` (a warning)
    """
    work = df.withColumns({"__base_text": base, "__extra_text": extra})
    work = with_object(work, "__base", F.col("__base_text"))
    base_doc, extra_text = F.col("__base"), F.col("__extra_text")
    if field is None:
        work = with_object(work, "__new", extra_text)
        nothing = _is_bare(extra_text, "null", "false")
        mergeable = F.col("__new").isNotNull()
        merged = overlay_maps(base_doc, F.col("__new"))
    else:
        work = with_member(work, "__new", extra_text, field)
        member = F.try_element_at(base_doc, F.lit(field))
        work = work.withColumns(
            {
                "__old": F.try_variant_get(member, "$", _OBJECT.simpleString()),
                "__old_blank": member.isNull() | F.is_variant_null(member),
                "__is_object": F.json_object_keys(extra_text).isNotNull(),
            }
        )
        old, new, is_object = F.col("__old"), F.col("__new"), F.col("__is_object")
        nothing = _is_bare(extra_text, "null") | (
            is_object & new.isNull() & _lacks_member(extra_text, field)
        )
        mergeable = is_object & new.isNotNull() & (old.isNotNull() | F.col("__old_blank"))
        inner = F.to_variant_object(overlay_maps(old, new))
        merged = overlay_maps(base_doc, F.create_map(F.lit(field), inner))
    outcome = (
        F.when(extra_text.isNull(), "absent")
        .when(nothing, "empty")
        .when(mergeable, "merged")
        .otherwise("invalid")
    )
    work = work.withColumn("__status", outcome)
    result = F.when(F.col("__status") == "merged", merged).otherwise(base_doc)
    text = F.when(base_doc.isNotNull(), F.to_json(result, _KEEP_NULLS))
    return work.select(*df.columns, text.alias(doc), F.col("__status").alias(status))


def _is_bare(text: Column, *words: str) -> Column:
    return F.btrim(text, F.lit(_JSON_SPACE)).isin("", *words)


def _lacks_member(text: Column, field: str) -> Column:
    as_boolean = F.from_json(text, T.StructType().add(field, T.BooleanType()))[field]
    is_false = F.coalesce(~as_boolean, F.lit(False))
    return F.get_json_object(text, f"$['{field}']").isNull() | is_false
