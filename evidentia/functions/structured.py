"""What pages say of their shop in JSON-LD blocks and meta tags, read as variants: no schema, any nesting, nothing that fails."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text

STRINGS, VARIANTS, FIELDS = "array<string>", "array<variant>", "map<string,variant>"


def _none(kind: str) -> Column:
    return F.array().cast(kind) if kind == STRINGS else F.filter(F.array(F.parse_json(F.lit("null"))), lambda x: F.lit(False))


def json_object(value: Column) -> Column:
    """A JSON text's object as map<string, variant>; empty for what is no object or cannot be read."""
    return F.coalesce(_fields(F.try_parse_json(value)), F.from_json(F.lit("{}"), "map<string,string>").cast(FIELDS))


def _fields(value: Column) -> Column:
    """An object's fields; null for what is no object. Fields are looked up here, as a path that leads nowhere costs a variant an exception."""
    return F.try_variant_get(value, "$", FIELDS)


def json_values(value: Column, path: str = "$") -> Column:
    """The strings at a path of a variant: of a lone string, number or truth value, or of a list of such; none of objects."""
    at = value if path == "$" else F.try_variant_get(value, path, "variant")
    kind = F.schema_of_variant(at)
    many = F.transform(F.try_variant_get(at, "$", VARIANTS), lambda x: F.when(~F.schema_of_variant(x).rlike("^(OBJECT|ARRAY|VOID)"), F.try_variant_get(x, "$", "string")))
    found = F.when(at.isNull(), _none(STRINGS)).when(kind.startswith("ARRAY"), many).when(kind.rlike("^(OBJECT|VOID)"), _none(STRINGS)).otherwise(F.array(F.try_variant_get(at, "$", "string")))
    return F.filter(F.coalesce(found, _none(STRINGS)), lambda x: x.isNotNull() & (F.trim(x) != ""))


def items_of_blocks(blocks: Column) -> Column:
    """The objects of JSON-LD blocks: the members of a list, of an object's @graph, or the object itself; blocks that cannot be read have none."""
    def items(v: Column) -> Column:
        graph = _fields(v)["@graph"]
        listed = F.when(F.schema_of_variant(v).startswith("ARRAY"), F.try_variant_get(v, "$", VARIANTS)).when(graph.isNotNull(), F.try_variant_get(graph, "$", VARIANTS)).otherwise(F.array(v))
        return F.filter(F.coalesce(listed, _none(VARIANTS)), lambda x: F.schema_of_variant(x).startswith("OBJECT"))

    read = F.filter(F.transform(F.coalesce(blocks, _none(STRINGS)), lambda b: F.try_parse_json(b)), lambda v: v.isNotNull())
    return F.flatten(F.transform(read, items))


def _bound(value: Column, found) -> Column:
    """What is found of a value that is computed once, however often it is named."""
    return F.get(F.transform(F.array(value), found), F.lit(0))


def _values(fields: Column, *names: str) -> Column:
    return F.concat(*[json_values(fields[n]) for n in names])


def _said(item: Column) -> Column:
    """What is taken of an item: its whole JSON text, and the strings of its fields."""
    def of_fields(own: Column) -> Column:
        parts = _bound(_fields(own["address"]), lambda a: F.concat(*[F.slice(json_values(a[p]), 1, 1) for p in ("streetAddress", "postalCode", "addressLocality")]))
        return F.struct(
            F.to_json(item).alias("whole"), _values(own, "taxID", "vatID", "leiCode").alias("own"), _values(own, "email", "contactEmail").alias("mail"),
            _values(own, "telephone", "faxNumber", "contactTelephone").alias("called"), parts.alias("parts"),
        )

    return _bound(_fields(item), of_fields)


def _each(values: Column, found) -> Column:
    return F.flatten(F.transform(values, found))


def _set(*lists: Column) -> Column:
    return F.array_sort(F.array_distinct(F.concat(*[F.coalesce(x, _none(STRINGS)) for x in lists])))


def _plain_number(value: Column) -> Column:
    """A register number that stands alone."""
    return F.when(F.trim(value).rlike("^[1-9][0-9]{7}$"), F.array(F.trim(value))).otherwise(_none(STRINGS))


def _metas(metas: Column, *names: str) -> Column:
    named = F.filter(F.coalesce(metas, F.array().cast("array<struct<name:string,content:string>>")), lambda m: F.lower(F.coalesce(m["name"], F.lit(""))).rlike("|".join(names)) & (F.trim(m["content"]) != ""))
    return F.transform(named, lambda m: F.trim(m["content"]))


def structured_entities(ldjson: Column, metas: Column) -> Column:
    """E-mail addresses, telephone, register, tax and bank numbers, and postal addresses (two parts at least) of a page's JSON-LD blocks and meta
    tags: sorted sets in a struct. Fields may be lists; numbers are also looked for in an item's whole JSON text."""
    def of_items(items: Column) -> Column:
        every = lambda name: F.flatten(F.transform(items, lambda x: x[name]))
        whole, own, mail = F.transform(items, lambda x: x["whole"]), every("own"), F.concat(every("mail"), _metas(metas, "email"))
        called = F.concat(every("called"), _metas(metas, "phone", "telefoon", "tel"))
        registered, taxed = _metas(metas, "kvk", "coc", "chamber"), _metas(metas, "vat", "btw", "tax")
        parts = F.transform(items, lambda x: x["parts"])
        return F.struct(
            _set(F.filter(F.transform(mail, lambda v: F.lower(F.trim(v))), lambda v: v.contains("@"))).alias("emails"), _set(_each(called, text.phones)).alias("phones"),
            _set(_each(F.concat(own, whole, registered), text.kvk_numbers), _each(F.concat(own, registered), _plain_number)).alias("kvk"), _set(_each(F.concat(own, whole, taxed), text.vat_numbers)).alias("btw"),
            _set(_each(whole, text.ibans)).alias("iban"), _set(F.transform(F.filter(parts, lambda p: F.size(p) >= 2), lambda p: F.array_join(p, " "))).alias("addresses"),
        )

    return _bound(F.transform(items_of_blocks(ldjson), _said), of_items)
