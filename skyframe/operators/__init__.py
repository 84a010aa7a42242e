"""Set-oriented operators: joins, aggregates, windows and iterations."""
