"""Manual review decisions and what follows from them.  Files are never moved here: results are plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.scale import last_per_key

RECLASSIFY = ("NC", "VEN", "ART", "DELAY")


def upsert_decisions(decisions: DataFrame) -> DataFrame:
    """The last decision per key (by ``ord``); a last ``CLEAR`` removes the key."""
    return current_decisions(last_per_key(decisions, ["key"], F.col("ord")))


def current_decisions(state: DataFrame) -> DataFrame:
    """The decisions in force, of a table with the last row of every key."""
    return state.where(F.col("action") != "CLEAR")


def _new_phase(action: Column, allowed=RECLASSIFY) -> Column:
    return F.when(F.upper(action).isin(*allowed), F.lower(action))


def apply_reclassification(manifest: DataFrame, decisions: DataFrame, on: str = "filename") -> DataFrame:
    """Manifest with ``phase`` and ``protocol_source`` set by the decisions on the file name."""
    changes = (
        decisions.select(F.col(on), _new_phase(F.col("action")).alias("_p"), "ord").where("_p is not null")
    )
    changes = last_per_key(changes, [on], F.col("ord")).drop("ord")
    return (
        manifest.join(changes, on, "left")
        .withColumns(
            {
                "phase": F.coalesce("_p", "phase"),
                "protocol_source": F.when(F.col("_p").isNotNull(), "manual").otherwise(F.col("protocol_source")),
            }
        )
        .drop("_p")
    )


def missing_reclassifications(manifest: DataFrame, decisions: DataFrame, on: str = "filename") -> DataFrame:
    wanted = decisions.where(_new_phase(F.col("action")).isNotNull())
    return wanted.join(manifest.select(on).distinct(), on, "left_anti")


def soft_delete_plan(decisions: DataFrame, files: DataFrame, live: str = "nifti", dead: str = "deleted") -> DataFrame:
    """Per deleted name: from, to and state ``move``, ``done`` or ``missing`` by the file table (``path``)."""
    names = decisions.where("action = 'delete'").select("filename").distinct()
    plan = names.select(
        "filename",
        F.concat(F.lit(f"{live}/"), "filename").alias("from_path"),
        F.concat(F.lit(f"{dead}/"), "filename").alias("to_path"),
    )
    return _plan_state(plan, files)


def _plan_state(plan: DataFrame, files: DataFrame) -> DataFrame:
    known = files.select("path").distinct()
    source = known.select(F.col("path").alias("from_path"), F.lit(True).alias("_src"))
    target = known.select(F.col("path").alias("to_path"), F.lit(True).alias("_dst"))
    state = F.when(F.col("_dst"), "done").when(F.col("_src"), "move").otherwise("missing")
    return (
        plan.join(source, "from_path", "left")
        .join(target, "to_path", "left")
        .withColumn("state", state)
        .drop("_src", "_dst")
    )


def soft_delete(manifest: DataFrame, plan: DataFrame) -> DataFrame:
    """Manifest in which the names that move now have phase ``deleted``."""
    moving = plan.where("state = 'move'").select("filename", F.lit(True).alias("_d"))
    return (
        manifest.join(moving, "filename", "left")
        .withColumns(
            {
                "phase": F.when(F.col("_d"), "deleted").otherwise(F.col("phase")),
                "protocol_source": F.when(F.col("_d"), "manual").otherwise(F.col("protocol_source")),
            }
        )
        .drop("_d")
    )


def append_log(old: DataFrame | None, plan: DataFrame) -> DataFrame:
    moved = plan.where("state = 'move'").select("from_path", "to_path")
    return moved if old is None else old.select("from_path", "to_path").union(moved)


def run_moves(plan: DataFrame, run: int) -> DataFrame:
    """The moves of one run as rows of the move log."""
    return append_log(None, plan).select(F.lit(run).cast("bigint").alias("run"), "from_path", "to_path")


def _path_states(before: DataFrame, plan: DataFrame) -> DataFrame:
    """``path, was, is``: whether a file stood at the path before the plan and stands there after it.

    The file table and the plan are read once each; a path that is listed, left or reached more than once counts once.
    """
    moves = plan.where("state = 'move'").select(
        F.inline(
            F.array(
                F.struct(F.col("from_path").alias("path"), F.lit(-1).alias("sign")),
                F.struct(F.col("to_path").alias("path"), F.lit(1).alias("sign")),
            )
        )
    )
    signs = before.select("path", F.lit(0).alias("sign")).union(moves)
    folded = signs.groupBy("path").agg(
        F.bool_or(F.col("sign") == 0).alias("was"), F.bool_or(F.col("sign") < 0).alias("_left"), F.bool_or(F.col("sign") > 0).alias("_came")
    )
    return folded.select("path", "was", (F.col("_came") | (F.col("was") & ~F.col("_left"))).alias("is"))


def files_after(before: DataFrame, plan: DataFrame) -> DataFrame:
    """The different paths of the file table once the plan is carried out."""
    return _path_states(before, plan).where("is").select("path")


def _two_roots(rows: DataFrame, folder: Column, to_root: str, to_folder: Column) -> DataFrame:
    both = rows.withColumn("kind", F.explode(F.array(F.lit("images"), F.lit("mask"))))
    return both.select(
        "kind",
        "key",
        F.concat_ws("/", "kind", "class", "patient_id", folder, "filename").alias("from_path"),
        F.concat(F.lit(to_root), F.concat_ws("/", "kind", "class", "patient_id", to_folder, "filename")).alias("to_path"),
    )


def relocation_plan(decisions: DataFrame, files: DataFrame) -> DataFrame:
    """Moves of image and mask for phase changes of VOI files (``class, patient_id, protocol, filename, action``)."""
    new = F.upper("action")
    rows = decisions.where(new.isin("NC", "ART", "VEN") & (F.col("protocol") != new)).withColumn("_new", new)
    return _plan_state(_two_roots(rows, F.col("protocol"), "", F.col("_new")), files)


def deletion_plan(decisions: DataFrame, files: DataFrame) -> DataFrame:
    """Moves of image and mask of deleted VOI files below ``deleted/``."""
    rows = decisions.where("action = 'delete'")
    return _plan_state(_two_roots(rows, F.col("protocol"), "deleted/", F.col("protocol")), files)


def rewrite_keys(decisions: DataFrame) -> DataFrame:
    """Decisions whose key and protocol follow their phase change."""
    new = F.upper("action")
    changed = new.isin("NC", "ART", "VEN") & (F.col("protocol") != new)
    protocol = F.when(changed, new).otherwise(F.col("protocol"))
    return decisions.withColumn("_p", protocol).withColumns(
        {
            "key": F.when(changed, F.concat_ws("/", "class", "patient_id", "_p", "filename")).otherwise(F.col("key")),
            "protocol": F.col("_p"),
        }
    ).drop("_p")


def _ancestors(path: Column) -> Column:
    """All directories above a path, the nearest included."""
    parts = F.split(path, "/")
    return F.when(
        F.size(parts) > 1,
        F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/")),
    ).otherwise(F.array().cast("array<string>"))


def empty_dirs(before: DataFrame, plan: DataFrame, roots: tuple[str, ...] = ("images", "mask")) -> DataFrame:
    """Directories that hold no file any more once the plan is carried out, deepest included; roots are kept.

    Paths are rolled up to their own directories first; only these list their ancestors.
    """
    nearest = _path_states(before, plan).groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("d"))
    own = nearest.agg(F.bool_or("was").alias("was"), F.bool_or("is").alias("is"))
    under = F.lit(False)
    for root in roots:
        under = under | F.col("directory").startswith(root + "/")
    held = own.select(F.explode(F.concat(_ancestors(F.col("d")), F.array("d"))).alias("directory"), "was", "is").where(under)
    states = held.groupBy("directory").agg(F.bool_or("was").alias("was"), F.bool_or("is").alias("is"))
    return states.where("was and not is").select("directory")


def review_summary(decisions: DataFrame, manifest: DataFrame, cases: DataFrame, files: DataFrame) -> DataFrame:
    """``section, item, n``: actions, new phases, manifest phases and groups, review phases, missing masks."""

    def counts(df, section, column):
        return df.groupBy(F.col(column).alias("item")).agg(F.count("*").alias("n")).select(
            F.lit(section).alias("section"), "item", "n"
        )

    new = decisions.where(_new_phase(F.col("action")).isNotNull()).withColumn("new", F.upper("action"))
    masks = files.select(F.col("path").alias("mask_path")).distinct()
    missing = cases.join(masks, "mask_path", "left_anti").agg(F.count("*").alias("n"))
    return (
        counts(decisions, "action", "action")
        .union(counts(new, "new_phase", "new"))
        .union(counts(manifest, "phase", "phase"))
        .union(counts(manifest, "group", "group"))
        .union(counts(cases, "protocol", "protocol"))
        .union(missing.select(F.lit("missing_masks").alias("section"), F.lit("all").alias("item"), "n"))
    )
