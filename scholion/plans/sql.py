"""Pieces of SQL for the independent checks of the queries."""

from __future__ import annotations

from scholion.functions.text import IES_SINGULAR, NOT_PLURAL, SIBILANTS
from scholion.operators.matching import Rules

SPACE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
INVISIBLE = r"[\x{200B}-\x{200D}\x{2060}\x{FEFF}\x{FFFD}]"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def squash(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{SPACE}+', ' ', 'g'))"


def ends(t: str, endings: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"ends_with({t}, '{e}')" for e in endings) + ")"


def tokens(x: str) -> str:
    """A list of normalised tokens."""
    exempt = ", ".join(map(quoted, IES_SINGULAR))
    one = (
        f"CASE WHEN length(t) <= 3 THEN t WHEN ends_with(t, 'ies') AND length(t) >= 5 AND t NOT IN ({exempt}) THEN t[:-4] || 'y' "
        f"WHEN ends_with(t, 'es') AND length(t) >= 5 AND {ends('t[:-3]', SIBILANTS)} THEN t[:-3] "
        f"WHEN ends_with(t, 's') AND NOT {ends('t', NOT_PLURAL)} THEN t[:-2] ELSE t END"
    )
    raw = f"list_filter(regexp_split_to_array(coalesce({x}, ''), '[^A-Za-z0-9]+'), lambda t: t <> '')"
    return f"list_transform(list_transform({raw}, lambda t: lower(t)), lambda t: {one})"


def padded(x: str) -> str:
    return f"(' ' || array_to_string({x}, ' ') || ' ')"


def has(text: str, rules: Rules, keyword: str) -> str:
    return "(" + (" OR ".join(f"contains({text}, ' {p} ')" for p in rules.phrases(keyword)) or "false") + ")"


def matches(text: str, rules: Rules, keywords: tuple[str, ...]) -> str:
    """The keywords that match, in order."""
    items = ", ".join(f"CASE WHEN {has(text, rules, k)} THEN {quoted(k)} END" for k in keywords)
    return f"list_filter([{items}], lambda k: k IS NOT NULL)"


def drop_contained(phrases: str) -> str:
    """Phrases that run in no longer phrase of the list."""
    k = lambda v: padded(tokens(v))
    # Tokens of a configured phrase: the check recomputes them for every pair of the short list.
    return f"list_filter({phrases}, lambda a: len(list_filter({phrases}, lambda b: len({tokens('b')}) > len({tokens('a')}) AND contains({k('b')}, {k('a')}))) = 0)"


def unique_ci(items: str) -> str:
    clean = f"list_filter(list_transform(coalesce({items}, []), lambda s: {squash('s')}), lambda s: s <> '')"
    return f"list_filter({clean}, lambda s, i: list_position(list_transform({clean}, lambda u: lower(u)), lower(s)) = i)"


def date_range(x: str) -> tuple[str, str]:
    """First and last day of a date text; NULL where it has none."""
    y, m, d = (f"split_part(trim(coalesce({x}, '')), '-', {i})" for i in (1, 2, 3))
    ok = f"regexp_full_match(trim(coalesce({x}, '')), '\\s*\\d{{1,4}}\\s*(-\\s*\\d+\\s*(-\\s*\\d+\\s*(-.*)?)?)?')"
    num = lambda c: f"coalesce(try_cast(nullif(trim({c}), '') AS INTEGER), 0)"
    ny, nm, nd = num(y), num(m), num(d)
    full = f"try_cast(printf('%04d-%02d-%02d', {ny}, {nm}, {nd}) AS DATE)"
    month = f"try_cast(printf('%04d-%02d-01', {ny}, {nm}) AS DATE)"
    lo = f"CASE WHEN {ok} AND {ny} > 0 THEN CASE WHEN {nm} > 0 AND {nd} > 0 THEN {full} WHEN {nm} > 0 THEN {month} ELSE try_cast(printf('%04d-01-01', {ny}) AS DATE) END END"
    hi = f"CASE WHEN {ok} AND {ny} > 0 THEN CASE WHEN {nm} > 0 AND {nd} > 0 THEN {full} WHEN {nm} > 0 THEN last_day({month}) ELSE try_cast(printf('%04d-12-31', {ny}) AS DATE) END END"
    return lo, hi


def journal_key(x: str) -> str:
    t = f"regexp_replace(upper(trim(coalesce({x}, ''))), '\\([^)]*\\)', ' ', 'g')"
    return f"trim(regexp_replace(replace({t}, '&', 'AND'), '[^A-Z0-9]+', ' ', 'g'))"


def display(x: str) -> str:
    control = r"[\x{00}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}\x{200B}-\x{200D}\x{2060}\x{FEFF}\x{FFFD}]"
    inner = f"regexp_replace({squash(x)}, '{control}', '', 'g')"
    return f"trim({squash(inner)}, ' .;:,')"


def contains_any(x: str, markers: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({x}, {quoted(m)})" for m in markers) + ")"


def section_hits(x: str) -> str:
    from scholion.operators.evidence import SECTIONS

    # Written without look-around: a mark that is neither letter nor colon on either side, or an end.
    return "(" + " + ".join(f"CAST(regexp_matches(lower(coalesce({x}, '')), '(^|[^a-z]){s}([^a-z:]|$)') AS INTEGER)" for s in SECTIONS) + ")"
