"""Prompt assembly per request: ordered aggregates per tileset, joined once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.operators.lookup import lookup
from gridweave.session import cut

LAYERS = ("background", "terrain", "walls", "platform", "foreground", "effects")  # fixed values
#: Our own wording of the standing rules.
RULES = ("Use palette symbols only. Give one grid row per line. Light falls from the top left. "
         "Match neighbouring edges. Name a target layer.")


def lines(df: DataFrame, by: list[str], order: list[str], text: Column, out: str, glue: str = "\n") -> DataFrame:
    """Ordered lines of a small list per group (palette, examples, advice, passages)."""
    return df.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct(*order, text.alias("_t")))), lambda c: c["_t"]), glue).alias(out))


def section(title: str, col: str) -> Column:
    return F.when(F.coalesce(F.col(col), F.lit("")) != "", F.concat(F.lit(f"{title}\n"), F.col(col)))


def theme_text(name: str = "name", most: str = "max_palette_size", light: str = "light_source", roles: str = "roles") -> Column:
    """A theme as lines: name, limits, then the roles in order."""
    each = F.transform(F.array_sort(F.map_entries(roles)), lambda e: F.concat(F.lit("Role "), e["key"], F.lit(" = "), e["value"]))
    return F.concat_ws("\n", F.concat(F.lit("Active theme: "), name), F.concat(F.lit("Max palette size: "), F.col(most).cast("string")),
                       F.concat(F.lit("Light source: "), light), F.when(F.size(roles) > 0, F.array_join(each, "\n")))


def prompt_context(requests: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    """``requests(request_id, tileset_id, prompt, size)`` -> ``system_prompt, user_prompt``.

    ``parts`` maps a section to a table with its text: ``palette, theme, style,
    preferred, edges, examples, avoid`` per ``tileset_id`` and ``knowledge`` per
    ``request_id``; a section without a row is left out.
    """
    titles = {"palette": "Palette:", "theme": "Theme:", "style": "Style:", "preferred": "Preferred style:", "edges": "Edge classes:",
              "examples": "Accepted tiles:", "avoid": "Reviewer constraints:"}
    j = requests
    for name in [*titles, "knowledge"]:
        if name in parts:
            j = j.join(parts[name], "request_id" if name == "knowledge" else "tileset_id", "left")
        else:
            j = j.withColumn(f"{name}_text", F.lit(None).cast("string"))
    system = F.concat_ws(
        "\n", F.lit("You draw symbol-grid tiles."), section(titles["palette"], "palette_text"), section(titles["theme"], "theme_text"),
        section(titles["style"], "style_text"), section(titles["preferred"], "preferred_text"), F.concat(F.lit("Canvas size: "), "size"),
        F.lit("Target layers: " + ", ".join(LAYERS)), section(titles["edges"], "edges_text"), section(titles["examples"], "examples_text"),
        section(titles["avoid"], "avoid_text"), F.lit(RULES))
    user = F.concat_ws("\n", section("Retrieved technique notes:", "knowledge_text"), F.concat(F.lit("Generate a "), "size", F.lit(" tile: "), "prompt"))
    return j.select("request_id", "tileset_id", system.alias("system_prompt"), user.alias("user_prompt"))


def preview(grid: str = "grid") -> Column:
    return F.array_join(F.slice(F.split(grid, "\n"), 1, 4), "\n")


def _paired(pairs: DataFrame, tiles: DataFrame) -> DataFrame:
    """Pairs with both tiles' columns and ``_tail``, the user prompt without passages."""
    t = tiles.select("tileset_id", "name", *"nesw", "size", preview().alias("preview"))
    side = lambda p: t.select("tileset_id", F.col("name").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in ("n", "e", "s", "w", "size", "preview")])
    tail = F.concat_ws(
        "\n", F.concat(F.lit("Tile A "), "a", F.lit(":\n"), "a_preview"),
        F.concat(F.lit("Tile B "), "b", F.lit(":\n"), "b_preview"), F.concat(F.lit("Blend "), "a", F.lit(" into "), "b", F.lit(" from top to bottom.")))
    return pairs.join(side("a"), ["tileset_id", "a"]).join(side("b"), ["tileset_id", "b"]).withColumn("_tail", tail)


def _notes() -> Column:
    return section("Retrieved technique notes:", "knowledge_text")


def _known(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("?"))


#: Columns of a context that aren't text.
CONTEXT = ("pair_id", "tileset_id", "a", "b")
EDGES = (("a_n", "n"), ("a_e", "e"), ("b_n", "s"), ("a_w", "w"))


def transition_context(pairs: DataFrame, tiles: DataFrame, tilesets: DataFrame) -> DataFrame:
    """``pairs(pair_id, tileset_id, a, b)`` -> edges, previews of four rows and prompts.

    ``tilesets`` has ``palette_text`` and ``knowledge_text`` per ``tileset_id``;
    either may be missing or null.
    """
    j = lookup(_paired(pairs, tiles), cut(tilesets), ["tileset_id"])
    for c in ("palette_text", "knowledge_text"):
        if c not in j.columns:
            j = j.withColumn(c, F.lit(None).cast("string"))
    system = F.concat_ws(
        "\n", F.concat(F.lit("You draw a "), "a_size", F.lit(" transition tile.")), section("Palette:", "palette_text"),
        F.concat(F.lit("North, east and west edges: "), _known("a_n"), F.lit("; south edge: "), _known("b_n")), F.lit("Dither the boundary. Reply with the grid alone."))
    return j.select(*CONTEXT, *[_known(c).alias(e) for c, e in EDGES], system.alias("system_prompt"), F.concat_ws("\n", _notes(), "_tail").alias("user_prompt"))


#: Characters of passages, over all tilesets, that every task may hold.
HELD = 1 << 25


def transition_digests(pairs: DataFrame, tiles: DataFrame, tilesets: DataFrame) -> DataFrame:
    """:func:`transition_context` with ``user_digest``, the md5 of the user prompt, in place of the prompts.

    A tileset's passages open all its prompts and are far longer than the rest:
    they are digested once a task and each prompt goes on from there.
    """
    sets = cut(tilesets.select("tileset_id", _notes().alias("_head")).where("_head IS NOT NULL"))
    if (sets.agg(F.sum(F.length("_head")).alias("n")).first().n or 0) > HELD:
        c = transition_context(pairs, tiles, tilesets)
        return c.select(*CONTEXT, *[e for _, e in EDGES], F.md5("user_prompt").alias("user_digest"))
    heads = pairs.sparkSession.sparkContext.broadcast({r.tileset_id: r._head for r in sets.collect()})
    j = _paired(pairs, tiles).select(*CONTEXT, *[_known(c).alias(e) for c, e in EDGES], "_tail")
    kept = j.columns[:-1]

    def run(parts):
        from hashlib import md5

        import pyarrow as pa

        at = kept.index("tileset_id")
        begun = {k: md5(f"{h}\n".encode()) for k, h in heads.value.items()}
        plain = md5()
        for batch in parts:
            made = []
            for k, tail in zip(batch.column(at).to_pylist(), batch.column(len(kept)).to_pylist()):
                h = begun.get(k, plain).copy()
                h.update(tail.encode())
                made.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made, pa.string())], names=[*kept, "user_digest"])

    return j.mapInArrow(run, ", ".join(f"`{c}` {j.schema[c].dataType.simpleString()}" for c in kept) + ", user_digest string")
