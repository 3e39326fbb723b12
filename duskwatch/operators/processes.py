"""Findings over the process forest: unexpected parents, and exploit chains as a pattern over its paths.

The pattern is a small automaton that reads a path from its root down. Each process start is a symbol, that is a
function of the automaton's states; the state of a process is the composition of the functions of all its ancestors and its
own. Compositions are found by doubling: a round joins each process with the ancestor reached so far, whose
composed function goes in front, so a path of n processes takes log n rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..adapters import SEC, security_events
from ..store import stored
from .relate import _P, edges, process_starts

#: States: nothing seen, below an exploited program, below a command shell that stands below one.
CLEAN, EXPLOITED, SHELL = 0, 1, 2
#: The next state for each state, by kind of process start.
STEPS = {"exploit": [EXPLOITED, EXPLOITED, SHELL], "shell": [CLEAN, SHELL, SHELL], "other": [CLEAN, EXPLOITED, SHELL]}
_ROWS = "array<int>"


def _contains_any(text: Column, words: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: text.contains(w))


def _by_child(child: Column, parent: Column, table: dict[str, list[str]], wanted: bool) -> Column:
    """Whether the parent's name is (or is not) among those of the table's line for the child."""
    out = F.lit(False)
    for name, parents in table.items():
        fits = _contains_any(parent, parents)
        out = F.when(child == name, fits if wanted else ~fits).otherwise(out)
    return F.coalesce(out, F.lit(False))


def named_starts(ev: DataFrame) -> DataFrame:
    """Process starts with the start of their parent and its name: the event's own, else the one found in the forest."""
    p = process_starts(ev)
    up = p.select(F.col("id").alias("parent_id"), F.col("process_name").alias("up_name"))
    e = edges(ev).join(up, "parent_id").select(F.col("child_id").alias("id"), "parent_id", "up_name")
    name = F.lower(F.coalesce(F.nullif("parent_process_name", F.lit("")), "up_name"))
    return p.join(e, "id", "left").select("id", "parent_id", F.lower("process_name").alias("process_name"), name.alias("parent_name"), "command_line")


def path_states(starts: DataFrame, symbols: DataFrame) -> DataFrame:
    """(id, state) of each start (id, parent_id): the state of the automaton after the path down to it.

    ``symbols`` is (id, f): f[s] is the state after this start in state s. Ends after as many rounds as the binary
    logarithm of the longest path.
    """
    state = stored(starts.select("id", F.col("parent_id").alias("up")).join(symbols, "id"))
    while not state.where("up IS NOT NULL").isEmpty():
        above = state.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("f").alias("_f"))
        composed = F.when(F.col("_f").isNull(), F.col("f")).otherwise(F.transform("_f", lambda s: F.get("f", s)))
        state = stored(state.join(above, "up", "left").select("id", F.col("_up").alias("up"), composed.alias("f")), over=state)
    return state.select("id", F.get("f", F.lit(CLEAN)).alias("state"))


def process_findings(ev: DataFrame) -> DataFrame:
    """(id, kind, process_name, parent_name): children of the web server and of the service manager, credential dumpers,
    system programs under an unexpected parent, exploited programs, and what runs below those at any depth."""
    p = stored(named_starts(ev))
    child, parent, text = F.col("process_name"), F.col("parent_name"), F.lower(F.concat_ws(" ", "process_name", "parent_name", "command_line"))
    exploit = _by_child(child, parent, rules.EXPLOIT_PARENTS, True)
    line = lambda kind: F.array(*map(F.lit, STEPS[kind])).cast(_ROWS)
    symbol = F.when(exploit, line("exploit")).when(child.isin(rules.SHELLS), line("shell")).otherwise(line("other"))
    states = path_states(p, p.select("id", symbol.alias("f")))
    kinds = {
        "w3wp_child": parent.contains("w3wp"),
        "services_child": parent.contains("services.exe"),
        "credential": _contains_any(text, rules.DUMP_WORDS),
        "masquerading": _by_child(child, parent, rules.SYSTEM_PARENTS, False),
        "exploit": exploit,
        "exploit_descendant": (F.col("state") == EXPLOITED) & ~exploit,
        "exploit_shell": F.col("state") == SHELL,
    }
    found = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in kinds.items()]))
    return p.join(states, "id").select("id", F.explode(found).alias("kind"), "process_name", "parent_name")


#: Names that the test events take, so that every rule and the chains have rows.
NAMES = ["firefox.exe", "acrord32.exe", "winword.exe", "explorer.exe", "cmd.exe", "powershell.exe", "svchost.exe", "services.exe", "lsass.exe", "wininit.exe", "w3wp.exe", "notepad.exe", "dllhost.exe"]
_NAME = f"[{', '.join(repr(n) for n in NAMES)}][CAST((row_id * 5 + k) % {len(NAMES)} + 1 AS INT)]"


def process_events(s, d) -> DataFrame:
    """Test events with those names; half of them don't tell their parent's name."""
    ev = security_events(s, d)
    name = F.element_at(F.array(*map(F.lit, NAMES)), ((F.col("row_id") * 5 + F.col("k")) % len(NAMES) + 1).cast("int"))
    return ev.withColumns({"process_name": name, "parent_process_name": F.when(F.col("row_id") % 2 == 0, F.col("parent_process_name"))})


_SEC = SEC.replace("sec AS", "sec0 AS", 1) + f", sec AS (SELECT * REPLACE ({_NAME} AS process_name, CASE WHEN row_id % 2 = 0 THEN parent_process_name END AS parent_process_name) FROM sec0)"
_STARTS = "n AS (SELECT p.id, p.process_name, coalesce(own.parent_process_name, up.process_name) AS parent_name, own.command_line FROM p JOIN sec own ON own.row_id = p.id LEFT JOIN e ON e.child_id = p.id LEFT JOIN p up ON up.id = e.parent_id)"
# the rules once more, written out for the names that the test events have
_PAIRS = (
    "((process_name = 'acrord32.exe' AND parent_name IN ('firefox.exe', 'chrome.exe')) OR (process_name = 'winword.exe' AND parent_name = 'explorer.exe'))",
    "((process_name = 'svchost.exe' AND parent_name <> 'services.exe') OR (process_name IN ('services.exe', 'lsass.exe') AND parent_name <> 'wininit.exe') OR (process_name = 'wininit.exe') OR (process_name = 'dllhost.exe' AND parent_name NOT IN ('svchost.exe', 'services.exe')))",
)
_WALK = (
    f"m AS (SELECT *, coalesce({_PAIRS[0]}, false) AS x, process_name IN ('cmd.exe', 'powershell.exe') AS sh FROM n), "
    "g AS (SELECT id, CASE WHEN x THEN 1 ELSE 0 END AS state FROM m WHERE id NOT IN (SELECT child_id FROM e) UNION ALL "
    "SELECT m.id, CASE WHEN g.state = 2 THEN 2 WHEN m.x THEN 1 WHEN g.state = 1 AND m.sh THEN 2 ELSE g.state END FROM g JOIN e ON e.parent_id = g.id JOIN m ON m.id = e.child_id)"
)
_KINDS = [
    ("w3wp_child", "parent_name = 'w3wp.exe'"), ("services_child", "parent_name = 'services.exe'"), ("credential", "regexp_matches(lower(concat_ws(' ', process_name, parent_name, command_line)), 'procdump|mimikatz|lsass|-ma ')"),
    ("masquerading", f"parent_name IS NOT NULL AND {_PAIRS[1]}"), ("exploit", "x"), ("exploit_descendant", "state = 1 AND NOT x"), ("exploit_shell", "state = 2"),
]
QUERIES = {"fe_process_trees": lambda s, d: process_findings(process_events(s, d))}
ORACLES = {"fe_process_trees": f"WITH RECURSIVE {_SEC}, {_P}, {_STARTS}, {_WALK}, r AS (SELECT m.*, state FROM m JOIN g USING (id)) " + " UNION ALL ".join(f"SELECT id, '{k}' AS kind, process_name, parent_name FROM r WHERE {c}" for k, c in _KINDS)}
