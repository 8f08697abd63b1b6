"""Table jobs: joins, aggregates, rules, audits, graphs, state, ordering and diffs."""
