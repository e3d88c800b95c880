"""Column functions on identifiers, free text, dates and paths.

Every function takes and returns Columns.  Most stay inside code generation; those that name a value with ``let`` are
evaluated by Spark's interpreter for lambdas.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortspark.functions import fixed


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# White space and word characters as Unicode classes; cheaper to match than the (?U) flag.
SPACE = r"[\s\p{Z}\x{1c}-\x{1f}\x{85}]"
WORD = r"[\p{L}\p{N}_]"

# All white-space characters.
SPACES = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Trim all white space, not blanks only; looks at the ends of the text only."""
    return F.btrim(c, F.lit(SPACES))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def get_tag(tags: Column, key: str, default: str = "") -> Column:
    return F.coalesce(strip(tags[key]), F.lit(default))


def clean_cell(c: Column) -> Column:
    return let(
        strip(c.cast("string")),
        lambda text: F.when(text.isNull() | F.lower(text).isin("nan", "none"), "")
        .when(text.rlike(r"(?U)^\d+\.0$"), F.regexp_replace(text, r"\.0$", ""))
        .otherwise(text),
    )


def sanitize_id(c: Column) -> Column:
    words = F.regexp_replace(F.regexp_replace(c, r"(?U)[^\w\-.]", "_"), "_+", "_")
    return let(F.btrim(words, F.lit("_.")), lambda kept: F.when(kept != "", kept).otherwise("UNKNOWN"))


def is_valid_pid(c: Column) -> Column:
    dotted_number = c.rlike(r"^[0-9.]+$") & c.contains(".")
    stop_word = F.lower(c).isin(fixed.STOP_IDS)
    return F.coalesce((F.length(c) >= 2) & ~stop_word & ~dotted_number, F.lit(False))


def normalize_patient_key(raw: Column) -> Column:
    def key_of(ident):
        token = F.regexp_replace(F.regexp_extract(ident, r"(?i)^anonym[-_]?(.+)$", 1), r"^[-_]+", "")
        return F.when(ident.rlike(r"(?i)^anonym[-_]?."), F.concat(F.lit("ANONYM-"), F.upper(token))).otherwise(
            F.upper(ident)
        )

    return let(clean_cell(raw), lambda text: F.when(text == "", "").otherwise(let(sanitize_id(text), key_of)))


_PATH_IDS = [
    (r"^TCGA-[A-Z0-9]{2}-[A-Z0-9]{4}", "directory_tcga"),
    (r"(?i)^anonym[-_]", "directory_ukbonn"),
    (r"^case_\d+", "directory_kits"),
    (r"^(?!CT_|MR_|PT_)[A-Za-z0-9][-_A-Za-z0-9]{2,}$", "directory_folder"),
]


def extract_patient_id(tags: Column, path: Column) -> Column:
    """``struct(patient_id, source)`` from three tags, else from the path read right to left.

    Candidates are arrays, so each value is worked out once and the generated code stays small.
    """
    names = F.array(
        *[
            F.struct(get_tag(tags, key).alias("v"), F.lit(f"dicom_{name}").alias("s"))
            for key, name in [
                (fixed.TAG_PATIENT_ID, "PatientID"),
                (fixed.TAG_PATIENT_NAME, "PatientName"),
                (fixed.TAG_OTHER_IDS, "OtherPatientIDs"),
            ]
        ]
    )
    from_tags = F.transform(F.filter(names, lambda n: is_valid_pid(n["v"])), lambda n: _identity(sanitize_id(n["v"]), n["s"]))

    def source_of(part):
        source = F.when(F.lit(False), F.lit(None))
        for pattern, label in _PATH_IDS:
            source = source.when(part.rlike(pattern), label)
        return source

    parts = F.filter(
        F.transform(F.reverse(F.split(path, "/")), lambda p: _identity(p, source_of(p))),
        lambda i: i["source"].isNotNull(),
    )
    from_path = F.transform(
        parts,
        lambda i: _identity(
            F.when(i["source"] == "directory_folder", sanitize_id(i["patient_id"])).otherwise(i["patient_id"]), i["source"]
        ),
    )
    return F.coalesce(
        F.get(from_tags, F.lit(0)), F.get(from_path, F.lit(0)), _identity(F.lit("UNKNOWN"), F.lit("fallback"))
    )


def _identity(patient_id: Column, source: Column) -> Column:
    return F.struct(patient_id.alias("patient_id"), source.alias("source"))


def patient_id_from_case(case_name: Column, pattern: str | None = None) -> Column:
    """First group of ``pattern`` that took part, else ``case_`` and five digits, else the name."""
    choices = []
    if pattern:
        groups = range(1, re.compile(pattern).groups + 1)
        choices += [blank_to_null(F.regexp_extract(case_name, pattern, g)) for g in [*groups, 0]]
    choices.append(blank_to_null(F.regexp_extract(case_name, r"case_\d{5}", 0)))
    return F.coalesce(*choices, case_name)


def normalize_case_id(raw: Column) -> Column:
    digits = F.regexp_extract(raw, r"\d+", 0)
    number = F.regexp_replace(digits, r"^0+(?=\d)", "")
    padded = F.when(F.length(number) < 5, F.lpad(number, 5, "0")).otherwise(number)
    return F.when(digits != "", F.concat(F.lit("case_"), padded)).otherwise(raw)


def case_id(number: Column) -> Column:
    return F.format_string("case_%05d", number)


def norm_text(c: Column) -> Column:
    spaced = F.translate(F.lower(F.coalesce(c, F.lit(""))), "_/-", "   ")
    return F.trim(F.regexp_replace(spaced, rf"{SPACE}+", " "))


def _spell_out(normed: Column) -> Column:
    """Words between blanks, every other character as a mark of its own.

    A whole keyword is then found by plain search for it between blanks, which is much cheaper on long texts than
    an alternation with word boundaries, and a mark keeps words apart that a comma had parted.
    """
    return F.concat(F.lit(" "), F.regexp_replace(normed, r"[^\p{L}\p{N}_ ]", " \u0001 "), F.lit(" "))


def _any_word(spelled: Column, words: list[str]) -> Column:
    return reduce(or_, [spelled.contains(f" {word} ") for word in words])


def _number_before(normed: Column, unit: str, digits: str) -> Column:
    """The number in front of a unit; texts without the unit are not scanned."""
    pattern = rf"(?<!{WORD})(\d{{{digits}}})\s*{unit}(?!{WORD})"
    return F.when(normed.contains(unit), blank_to_null(F.regexp_extract(normed, pattern, 1)).try_cast("int"))


def classify_phase_text(c: Column) -> Column:
    """``nc``, ``art``, ``ven``, ``delay``, ``excluded`` or ``undefined``; the order of the rules matters."""

    return let(norm_text(c), classify_normed)


def classify_normed(normed: Column) -> Column:
    """The phase of a text that ``norm_text`` has already gone over."""

    def rules(spelled):
        return (
            F.when(_any_word(spelled, fixed.EXCLUDED_WORDS), "excluded")
            .when(_any_word(spelled, fixed.NATIVE_WORDS), "nc")
            .when(_any_word(spelled, fixed.ARTERIAL_WORDS), "art")
            .when(_any_word(spelled, fixed.DELAYED_WORDS), "delay")
            .when(_any_word(spelled, fixed.VENOUS_WORDS), "ven")
        )

    seconds, minutes = _number_before(normed, "sec", "2,3"), _number_before(normed, "min", "1,2")
    by_time = let(
        seconds,
        lambda s: F.when(s.between(15, 40), "art").when(s.between(55, 120), "ven").when(s >= 150, "delay"),
    )
    return F.coalesce(
        let(_spell_out(normed), rules), by_time, F.when(minutes >= 3, "delay"), F.lit("undefined")
    )


def _phase(phase: Column | str, source: str) -> Column:
    value = F.lit(phase) if isinstance(phase, str) else phase
    return F.struct(value.alias("phase"), F.lit(source).alias("source"))


def detect_protocol(tags: Column, path: Column) -> Column:
    """``struct(phase, source)``; excluded text ends the search as undefined."""
    text = F.concat_ws(
        " ", *[get_tag(tags, t) for t in (fixed.TAG_DESCRIPTION, fixed.TAG_PROTOCOL_NAME, fixed.TAG_SEQUENCE_NAME)]
    )
    by_name = let(
        classify_phase_text(path),
        lambda name: F.when(name.isin(fixed.PHASES), _phase(name, "filename"))
        .when(name == "excluded", _phase("undefined", "filename"))
        .otherwise(_phase("undefined", "undefined")),
    )
    return let(
        classify_phase_text(text),
        lambda meta: F.when(meta.isin(fixed.PHASES), _phase(meta, "metadata"))
        .when(meta == "excluded", _phase("undefined", "metadata"))
        .otherwise(by_name),
    )


def header_value(meta: Column, key: str, default: Column | None = None) -> Column:
    """Trimmed, non-empty header value, else the default (NULL if none is given)."""
    value = blank_to_null(strip(meta[key]))
    return value if default is None else F.coalesce(value, default)


def detect_phase_embedded(meta: Column, filename: Column) -> Column:
    """``struct(phase, source)`` from the embedded phase, the texts, the file name; excluded text does not end it."""
    text = F.concat_ws(" ", header_value(meta, "SeriesDescription"), header_value(meta, "ProtocolName"))
    found = F.struct(
        F.lower(header_value(meta, "DetectedProtocol")).alias("embedded"),
        classify_phase_text(text).alias("text"),
        classify_phase_text(filename).alias("name"),
    )
    return let(
        found,
        lambda f: F.when(f["embedded"] == "undefined", _phase("undefined", "undefined"))
        .when(f["embedded"].isin(fixed.PHASES), _phase(f["embedded"], "metadata"))
        .when(f["text"].isin(fixed.PHASES), _phase(f["text"], "metadata"))
        .when(f["name"].isin(fixed.PHASES), _phase(f["name"], "filename"))
        .otherwise(_phase("undefined", "undefined")),
    )


def spacing_severity(nonuniformity_mm: Column) -> Column:
    return (
        F.when(nonuniformity_mm > 50, "critical")
        .when(nonuniformity_mm > 10, "moderate")
        .when(nonuniformity_mm.isNotNull(), "minor")
        .otherwise("ok")
    )


def nonuniformity_from_warning(text: Column) -> Column:
    found = F.regexp_extract(text, r"(?i)maximum nonuniformity[:\s]+(\d+\.?\d*)", 1)
    return blank_to_null(found).try_cast("double")


def format_dicom_date(raw: Column) -> Column:
    parts = F.concat_ws("-", F.substring(raw, 1, 4), F.substring(raw, 5, 2), F.substring(raw, 7, 2))
    return F.when(F.length(raw) == 8, parts)


def format_dicom_time(raw: Column) -> Column:
    parts = F.concat_ws(":", F.substring(raw, 1, 2), F.substring(raw, 3, 2), F.substring(raw, 5, 2))
    return F.when(F.length(raw) >= 6, parts)


def age_at_scan(birth: Column, scan: Column) -> Column:
    """Years to one decimal, half to even; NULL where a date does not parse."""
    days = F.datediff(F.try_to_date(scan, "yyyy-MM-dd"), F.try_to_date(birth, "yyyy-MM-dd"))
    return F.bround(days / F.lit(365.25), 1)


def normalize_class(c: Column) -> Column:
    label = F.regexp_replace(F.upper(strip(c)), r"\+", "")
    return let(label, lambda v: F.when(v.isin(fixed.CLASS_LABELS), v).otherwise("NG"))


def _lookup(mapping: dict, c: Column) -> Column:
    pairs = [F.lit(v) for kv in mapping.items() for v in kv]
    return F.create_map(*pairs)[c]


def collapse_class(label: Column, strict: bool = False) -> Column:
    """Ten classes to A, B, D, NG; an unknown class is an error (strict) or NG."""
    unknown = F.raise_error(F.concat(F.lit("unexpected class label "), label)) if strict else F.lit("NG")
    return F.coalesce(_lookup(fixed.CLASS_CATEGORY, label), unknown)


def class_from_path(path: Column) -> Column:
    """The folder three levels above the file."""
    return F.get(F.reverse(F.split(path, "/")), F.lit(3))


def phase_code(folder: Column) -> Column:
    return _lookup(fixed.PHASE_CODE, F.upper(folder))


def class_code(category: Column) -> Column:
    return F.coalesce(_lookup(fixed.CATEGORY_CODE, category), F.lit(-1))


def parse_laterality(stem: Column) -> Column:
    """``struct(stem, side)``; side is NULL without an ``_L`` or ``_R`` ending."""
    side = blank_to_null(F.upper(F.regexp_extract(stem, r"(?i)_([LR])$", 1)))
    return F.struct(F.regexp_replace(stem, r"(?i)_[LR]$", "").alias("stem"), side.alias("side"))


def scan_index(filename: Column) -> Column:
    return F.coalesce(blank_to_null(F.regexp_extract(filename, r"^(\d+)_", 1)).try_cast("int"), F.lit(0))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def catalog_key(mask_path: Column, mask_root: str) -> Column:
    """Mask path below the root, else the bare file name."""
    root = mask_root.rstrip("/") + "/"
    below = F.substring(mask_path, len(root) + 1, 1 << 30)
    return F.when(mask_path.startswith(root), below).otherwise(base_name(mask_path))


def voi_output_path(kind: Column, group: Column, case: Column, phase: Column, name: Column, side: Column) -> Column:
    group = F.coalesce(blank_to_null(group), F.lit("NG"))
    phase = F.upper(F.coalesce(blank_to_null(phase), F.lit("undefined")))
    return F.concat_ws("/", kind, group, case, phase, F.concat(name, F.lit("_"), side, F.lit(".npy")))


def dataset_type(patient_id: Column) -> Column:
    key = normalize_patient_key(patient_id)
    return (
        F.when(patient_id.rlike(r"^TCGA-[A-Z0-9]{2}-[A-Z0-9]{4}"), "tcga")
        .when(key.rlike(r"^ANONYM-[A-Z0-9]+$|^\d+$"), "ukbonn")
        .when(patient_id.contains("KiTS") | patient_id.startswith("case_"), "kits")
        .otherwise("generic")
    )


def split_metric_tag(tag: Column) -> Column:
    """``struct(base, split)``; split is NULL without a train, val or test ending."""
    split = blank_to_null(F.regexp_extract(tag, r"/(train|val|test)$", 1))
    return F.struct(F.regexp_replace(tag, r"/(train|val|test)$", "").alias("base"), split.alias("split"))


def humanize(tag: Column) -> Column:
    text = strip(F.translate(tag, "/_", "  "))
    raised = F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1 << 30))
    return F.when(text == "", "Metric").otherwise(raised)


def slugify(tag: Column) -> Column:
    stem = F.btrim(F.regexp_replace(F.lower(tag), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.coalesce(blank_to_null(stem), F.lit("metric"))


def axis_spec(tag: Column) -> Column:
    """``struct(label, scale)`` for a metric."""
    spec = F.when(F.lit(False), F.lit(None))
    for pattern, label, scale in fixed.AXIS_LABELS:
        spec = spec.when(
            F.lower(tag).rlike(pattern), F.struct(F.lit(label).alias("label"), F.lit(scale).alias("scale"))
        )
    other = F.concat(humanize(tag), F.lit(" (a.u.)"))
    return spec.otherwise(F.struct(other.alias("label"), F.lit(1.0).alias("scale")))


def parse_monitor_name(name: Column) -> Column:
    """``struct(split, key)``; val without a prefix."""
    prefix = F.regexp_extract(name, "^(train|val)_", 1)
    return F.struct(
        F.coalesce(blank_to_null(prefix), F.lit("val")).alias("split"),
        F.regexp_replace(name, "^(train|val)_", "").alias("key"),
    )
