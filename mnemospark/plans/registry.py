"""All registered queries over the driver's tables: name, query and SQL."""

from __future__ import annotations

from mnemospark.plans import archive, exports, facts, queries, retrieval, upkeep

FLAGSHIP = queries.FLAGSHIP
REGISTERED: dict[str, tuple] = {**queries.REGISTERED, **archive.REGISTERED, **retrieval.REGISTERED, **facts.REGISTERED, **exports.REGISTERED, **upkeep.REGISTERED}
