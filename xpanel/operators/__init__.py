"""DataFrame operators on panels, series and portfolios."""
