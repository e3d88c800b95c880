"""SQL fragments for the check engine (DuckDB), independent of the Spark expressions."""

from __future__ import annotations

from cohortspark.functions import fixed

_EDGE = r"[^\p{L}\p{N}_]"
_SPACE = r"[\s\p{Z}\x{0b}\x{1c}-\x{1f}\x{85}]"


def strip(e: str) -> str:
    return rf"regexp_replace({e}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def clean(e: str) -> str:
    s = strip(e)
    return (
        f"case when {e} is null or lower({s}) in ('nan', 'none') then '' "
        rf"when regexp_full_match({s}, '\d+\.0') then regexp_replace({s}, '\.0$', '') else {s} end"
    )


def case_number(e: str) -> str:
    """A case id of digits: at least five of them, leading zeros beyond these dropped, none cut."""
    n = rf"regexp_replace({e}, '^0+(\d)', '\1')"
    return f"concat('case_', lpad({n}, greatest(5, length({n}))::int, '0'))"


def sanitize(e: str) -> str:
    return (
        rf"coalesce(nullif(trim(regexp_replace(regexp_replace({e}, '[^\p{{L}}\p{{N}}_\-.]', '_', 'g'), '_+', '_', 'g'), '_.'), ''), 'UNKNOWN')"
    )


def key(e: str) -> str:
    s = sanitize(f"({clean(e)})")
    return (
        f"case when ({clean(e)}) = '' then '' "
        f"when regexp_matches({s}, '(?i)^anonym[-_]?.') then "
        f"concat('ANONYM-', upper(regexp_replace(regexp_extract({s}, '(?i)^anonym[-_]?(.+)$', 1), '^[-_]+', ''))) "
        f"else upper({s}) end"
    )


def norm(e: str) -> str:
    return strip(rf"regexp_replace(translate(lower(coalesce({e}, '')), '_/-', '   '), '{_SPACE}+', ' ', 'g')")


def _words(words: list[str]) -> str:
    return f"(^|{_EDGE})(" + "|".join(words) + f")($|{_EDGE})"


def phase_of_norm(t: str) -> str:
    """Phase of an already normalised text column."""
    sec = rf"try_cast(nullif(regexp_extract({t}, '(^|{_EDGE})(\d{{2,3}})\s*sec($|{_EDGE})', 2), '') as int)"
    mins = rf"try_cast(nullif(regexp_extract({t}, '(^|{_EDGE})(\d{{1,2}})\s*min($|{_EDGE})', 2), '') as int)"
    return f"""case when regexp_matches({t}, '{_words(fixed.EXCLUDED_WORDS)}') then 'excluded'
      when regexp_matches({t}, '{_words(fixed.NATIVE_WORDS)}') then 'nc'
      when regexp_matches({t}, '{_words(fixed.ARTERIAL_WORDS)}') then 'art'
      when regexp_matches({t}, '{_words(fixed.DELAYED_WORDS)}') then 'delay'
      when regexp_matches({t}, '{_words(fixed.VENOUS_WORDS)}') then 'ven'
      when {sec} between 15 and 40 then 'art' when {sec} between 55 and 120 then 'ven' when {sec} >= 150 then 'delay'
      when {mins} >= 3 then 'delay' else 'undefined' end"""


def normalize_class(e: str) -> str:
    names = ", ".join(f"'{c}'" for c in fixed.CLASS_LABELS)
    s = f"replace(upper({strip(e)}), '+', '')"
    return f"case when {s} in ({names}) then {s} else 'NG' end"


CLASS_CASE = (
    "case when {c} in ('A','C','AC','AB','AD') then 'A' when {c} in ('B','BC','BD') then 'B' when {c} = 'D' then 'D' else 'NG' end"
)
