"""Path and text expressions that the operators share.  All JVM-side, no UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leakframe.functions.regex import let


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_name(path: Column) -> Column:
    """Name of the directory that holds the file, '' at the top."""
    return F.when(
        path.contains("/"), F.substring_index(F.regexp_replace(path, r"/[^/]*$", ""), "/", -1)
    ).otherwise(F.lit(""))


def suffix(path: Column) -> Column:
    """Last suffix with its dot, '' if none.  A leading dot does not start a suffix."""
    return F.regexp_extract(base_name(path), r"(?s)^.+(\.[^.]+)$", 1)


def extension(path: Column) -> Column:
    return F.lower(suffix(path))


def stem(path: Column) -> Column:
    """File name without its last suffix."""
    name = base_name(path)
    return F.substring(name, F.lit(1), F.length(name) - F.length(suffix(path)))


def entropy(value: Column) -> Column:
    """Shannon entropy in bits per character; 0 for the empty string.

    A character is counted by the length that the value loses without it, which is one native
    search for each distinct character."""

    def over(v: Column) -> Column:
        n = F.length(v)
        counts = F.transform(
            F.array_distinct(F.filter(F.split(v, ""), lambda c: c != "")),
            lambda c: (n - F.length(F.replace(v, c, F.lit("")))) / n.cast("double"),
        )
        return F.aggregate(counts, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))

    return F.coalesce(let(value, over), F.lit(0.0))


def newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def context_window(lines: Column, line_number: Column, size: int = 2) -> Column:
    """``size`` lines either side, numbered to width 4, the hit marked."""
    first = F.greatest(F.lit(1), line_number - size)
    window = F.slice(lines, first, line_number + size + 1 - first)
    numbered = F.transform(
        window,
        lambda line, i: F.concat(
            F.when(first + i == line_number, F.lit(">>> ")).otherwise(F.lit("    ")),
            pad_left((first + i).cast("string"), 4),
            F.lit(" | "),
            line,
        ),
    )
    return F.array_join(numbered, "\n")


def bare_context(lines: Column, line_number: Column, size: int = 2) -> Column:
    first = F.greatest(F.lit(1), line_number - size)
    return F.array_join(F.slice(lines, first, line_number + size + 1 - first), "\n")


def pad_left(text: Column, width: int) -> Column:
    """Pad to ``width``, never cut."""
    return F.concat(F.repeat(F.lit(" "), F.greatest(F.lit(0), F.lit(width) - F.length(text))), text)


def sha256(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


# what ``str.strip`` trims
_WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)


def python_strip(text: Column) -> Column:
    """Trim the whitespace that ``str.strip`` trims."""
    return F.btrim(text, F.lit(_WHITESPACE))


def _sql_string(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def lookup(key: Column, table: dict[str, str]) -> Column:
    """Map lookup over a small fixed table, NULL when the key is absent."""
    if any("${" in v for v in table.values()):  # SQL text would substitute it
        return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)
    entries = ", ".join(_sql_string(x) for kv in table.items() for x in kv)
    return F.try_element_at(F.expr(f"map({entries})"), key)


def first_hit(pairs) -> Column:
    """CASE WHEN over ordered (condition, value) pairs, NULL when none holds."""
    pairs = list(pairs)
    out = F.when(pairs[0][0], pairs[0][1])
    for cond, val in pairs[1:]:
        out = out.when(cond, val)
    return out


_BLOCK = 256  # lines are folded in blocks, so that appending stays cheap for any count
_FOLD = "struct<last:string,done:array<array<string>>,block:array<string>>"


def json_sections(lines: Column) -> Column:
    """For each line the name of the nearest object that opens above it, in one fold over the lines.

    An opening brace takes the name before it on its line, or at the end of the line above."""
    object_rx, open_rx = r'"([^"]+)"\s*:\s*\{', r'"([^"]+)"\s*:\s*$'
    above = F.concat(F.array(F.lit("")), F.slice(lines, F.lit(1), F.greatest(F.size(lines) - 1, F.lit(0))))
    opened = F.zip_with(lines, above, lambda line, prev: F.when(line.contains("{"), F.coalesce(
        F.nullif(F.regexp_extract(line, object_rx, 1), F.lit("")),
        F.nullif(F.regexp_extract(F.trim(prev), open_rx, 1), F.lit("")),
    )))

    def step(s: Column, name: Column) -> Column:
        return F.struct(F.coalesce(name, s["last"]).alias("last"), s["done"].alias("done"), F.concat(s["block"], F.array(s["last"])).alias("block"))

    def close(s: Column) -> Column:
        return F.struct(s["last"].alias("last"), F.concat(s["done"], F.array(s["block"])).alias("done"), F.array().cast("array<string>").alias("block"))

    zero = F.struct(F.lit(None).cast("string").alias("last"), F.array().cast("array<array<string>>").alias("done"), F.array().cast("array<string>").alias("block")).cast(_FOLD)

    def fold(names: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(names)), F.lit(_BLOCK))
        blocks = F.transform(starts, lambda i: F.slice(names, i, F.lit(_BLOCK)))
        return F.flatten(F.aggregate(blocks, zero, lambda s, b: F.aggregate(b, s, step, close), lambda s: s["done"]))

    return let(opened, fold)


def json_location(content: Column, lines: Column, sections: Column, value: Column) -> Column:
    """STRUCT(json_section, json_key) of a value: key on the first line that holds it, and the
    nearest object name above (``sections``, once for a text).  The first line is found by one
    search of the text; a value that spans lines is on none."""
    key_rx = r'"([^"]+)"\s*:\s*'
    at = F.when(~value.contains("\n"), F.nullif(F.position(value, content), F.lit(0)))

    def found(i: Column) -> Column:
        key = F.nullif(F.regexp_extract(F.get(lines, i), key_rx, 1), F.lit(""))
        return F.struct(F.when(key.isNotNull(), F.get(sections, i)).alias("json_section"), key.alias("json_key"))

    return let(at, lambda p: F.when(p.isNotNull(), let(newlines(F.substring(content, F.lit(1), p - 1)), found)))
