"""All queries of the core by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from parlance.plans import agents, blocks, files, instants, more, prompts, reports, texts

QUERIES = {"p2_found": instants.p2_found, "p6_found": blocks.p6_found, **reports.QUERIES, **texts.QUERIES, **more.QUERIES, **agents.QUERIES, **prompts.QUERIES, **files.QUERIES}
SQL: dict[str, str] = {"p2_found": instants.SQL, "p6_found": blocks.SQL, **reports.SQL, **texts.SQL, **more.SQL, **agents.SQL, **prompts.SQL, **files.SQL}
FLAGSHIP = reports.exact_dedup_by_source
