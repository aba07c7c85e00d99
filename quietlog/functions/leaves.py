"""JSON bodies as leaves: path -> (compact JSON text, kind).

Objects are flattened with '.', however deep; arrays and scalars, null included, are leaves; empty objects vanish; a key with a dot stays as written.
The kind keeps 3, 3.0 and "3" apart: null, bool, int, float, string, array. All of it runs in the JVM on VARIANT values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAF = "struct<json:string,kind:string>"


def kind_of(variant: str, json: str) -> str:
    """SQL of a leaf's kind, told by the first character of its JSON text; only of numbers the type is asked for."""
    return (
        f"case when startswith({json}, '\"') then 'string' when startswith({json}, '[') then 'array' when startswith({json}, 't') or startswith({json}, 'f') then 'bool' when startswith({json}, 'n') then 'null' "
        f"else if(schema_of_variant({variant}) in ('BIGINT', 'INT', 'SMALLINT', 'TINYINT'), 'int', 'float') end"
    )


def body(text: Column) -> Column:
    """A body as VARIANT, null where it is no JSON."""
    return F.try_parse_json(text)


def flattened(variant: str) -> str:
    """SQL of an array of (key, value, json) leaves.

    One pass replaces the objects among the entries by their members. A body cannot need more passes than it has opening braces, so their number bounds them, and
    passes stop where no object is left: flat bodies cost nothing more. Each member's JSON text is made once and tells objects, kinds and leaves."""
    entry = "struct({key} as key, c.value as value, to_json(c.value) as json)"
    members = f"transform(map_entries(try_cast({{v}} as map<string, variant>)), c -> {entry})"
    below = members.format(v="e.value", key="concat(e.key, '.', c.key)")
    first = members.format(v=variant, key="c.key")
    more = "exists({x}, e -> startswith(e.json, '{{'))"
    once = f"flatten(transform(acc.e, e -> if(startswith(e.json, '{{'), coalesce({below}, array()), array(e))))"
    go = f"x -> struct({more.format(x='x')} as go, x as e)"
    step = f"if(acc.go, element_at(transform(array({once}), {go}), 1), acc)"
    # Only members that are objects have braces to count.
    braces = "aggregate(x, 0, (n, e) -> if(startswith(e.json, '{'), n + length(e.json) - length(replace(e.json, '{', '')), n))"
    passes = f"aggregate(sequence(1, {braces}), struct(true as go, x as e), (acc, i) -> {step}).e"
    return f"element_at(transform(array({first}), x -> if({more.format(x='x')}, {passes}, x)), 1)"


def with_leaves(df: DataFrame, variant: str = "body", to: str = "leaves") -> DataFrame:
    """df with a map of leaves; an empty map for what is no object. Of two members with one path the later counts."""
    df = df.withColumn(to, F.expr(f"coalesce({flattened(variant)}, array())"))
    df = df.withColumn(to, F.expr(f"transform({to}, e -> struct(e.key as key, struct(e.json as json, {kind_of('e.value', 'e.json')} as kind) as value))"))
    last = f"filter({to}, (e, i) -> not exists(slice({to}, i + 2, size({to})), n -> n.key = e.key))"
    made = F.expr(f"map_from_entries(if(size(array_distinct({to}.key)) = size({to}), {to}, {last}))")
    # The optimizer would copy this into every predicate on the leaves and flatten the body once for each; it moves nothing past what it cannot foresee.
    return df.withColumn(to, F.when(F.spark_partition_id() >= 0, made))


def encoded_size(json: Column) -> Column:
    """UTF-8 bytes of compact JSON."""
    return F.octet_length(json).cast("long")


def member_size(path: str, json: str) -> str:
    """SQL of the bytes of a member in its object, with its comma: of the path only the last segment counts."""
    return f"cast(octet_length(to_json(struct(element_at(split({path}, '[.]'), -1) as k))) - 5 + octet_length({json}) + 1 as bigint)"


def text_of(json: str) -> str:
    """SQL of the text that a JSON string stands for; only one with escapes needs a parser. Of other JSON its text."""
    return f"if(startswith({json}, '\"') and not contains({json}, char(92)), substring({json}, 2, length({json}) - 2), get_json_object(concat('[', {json}, ']'), '$[0]'))"


def rendered(leaf: str) -> str:
    """SQL of a discriminator's text: strings as they are, whole floats without .0, null and arrays empty."""
    return (
        f"case {leaf}.kind when 'string' then {text_of(f'{leaf}.json')} when 'float' then "
        f"if(try_cast({leaf}.json as double) = floor(try_cast({leaf}.json as double)) and abs(try_cast({leaf}.json as double)) < 1e15, cast(cast(try_cast({leaf}.json as double) as bigint) as string), {leaf}.json) "
        f"when 'int' then {leaf}.json when 'bool' then {leaf}.json else '' end"
    )


def string_of(leaf: str) -> str:
    """SQL of a string leaf's text, or of any other leaf's JSON text."""
    return f"if({leaf}.kind = 'string', {text_of(f'{leaf}.json')}, {leaf}.json)"


def keyset(leaves: str = "leaves") -> Column:
    return F.expr(f"array_join(array_sort(map_keys({leaves})), '\\n')")


def present(leaf: str) -> str:
    return f"({leaf} is not null)"


def removed_members(before: str = "leaves", after: str = "kept") -> str:
    """SQL of the leaves gone, as array<struct<path, json, bytes>>."""
    return (
        f"transform(filter(map_entries({before}), e -> not map_contains_key({after}, e.key)), "
        f"e -> struct(e.key as path, e.value.json as json, {member_size('e.key', 'e.value.json')} as bytes))"
    )


def shells(before: str = "leaves", after: str = "kept") -> str:
    """SQL of the paths of objects that held a leaf before and hold none after."""
    parents = "array_distinct(flatten(transform(map_keys({m}), k -> transform(sequence(1, size(split(k, '[.]'))), i -> array_join(slice(split(k, '[.]'), 1, i - 1), '.')))))"
    return f"filter(array_except({parents.format(m=before)}, {parents.format(m=after)}), p -> p <> '')"


def rebuilt(leaves: str = "kept") -> str:
    """SQL of a JSON object text with the leaves as members, sorted by path: the dotted form of a body."""
    name = "substr(to_json(struct(k as k)), 6, length(to_json(struct(k as k))) - 6)"
    return f"concat('{{', array_join(transform(array_sort(map_keys({leaves})), k -> concat({name}, ':', element_at({leaves}, k).json)), ','), '}}')"
