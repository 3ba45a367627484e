"""Scripts of a deck: pages of a section one after the other, sections side by side, each page in at most two passes."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame

from decklore.functions.text import LABEL_CHARS

SCHEMA = "section string, page_no int, script string, passes int, n_red int, n_fix int, rewritten boolean"
Write = Callable[[str], str]
Check = Callable[[str, str], list[tuple[str, str]]]


def two_passes(prompt: str, content: str, write: Write, check: Check) -> tuple[str, int, list[tuple[str, str]]]:
    """The script, its passes and its issues (code, level). A second pass gets the list of faults; the better one stays, by
    red issues, then by others, and the second on a tie."""
    bad = lambda issues: (sum(level == "red" for _, level in issues), sum(level == "fix" for _, level in issues))
    first = write(prompt)
    issues = check(first, content)
    if bad(issues) == (0, 0):
        return first, 1, issues
    faults = "\n".join(f"- {code}" for code, level in issues if level in ("red", "fix"))
    second = write(f"{prompt}\n\n{first}\n\n{faults}")
    again = check(second, content)
    return (second, 2, again) if bad(again) <= bad(issues) else (first, 2, issues)


def write_sections(pages: DataFrame, existing: DataFrame, write: Write, check: Check, full: int = 3) -> DataFrame:
    """pages(section, page_no, content, page_hash), existing(section, page_no, script, page_hash, human) to SCHEMA.

    A page whose hash is as it was keeps its script, unless a page before it in the section was written anew; a page edited by
    hand always does, and spreads nothing. The last scripts before go into the prompt whole, older ones by their start.
    """

    def run(key: tuple, page: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
        was = {r.page_no: r for r in old.itertuples()}
        done, rows, dirty = [], [], False
        for p in page.sort_values("page_no").itertuples():
            o = was.get(p.page_no)
            keep = o is not None and (o.human or (not dirty and o.page_hash == p.page_hash))
            if keep:
                script, passes, issues = o.script, 0, check(o.script, p.content)
            else:
                before = [s[:LABEL_CHARS] for s in done[:-full]] + done[-full:]
                script, passes, issues = two_passes(json.dumps([p.content, before], ensure_ascii=False), p.content, write, check)
                dirty = True
            done.append(script)
            levels = [level for _, level in issues]
            rows.append((key[0], p.page_no, script, passes, levels.count("red"), levels.count("fix"), not keep))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return pages.groupBy("section").cogroup(existing.groupBy("section")).applyInPandas(run, SCHEMA)
