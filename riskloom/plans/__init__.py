"""Query plans: the named SQL analyses, notebook datasets, master/marts, risk index, dashboard
marts, their DuckDB oracles and the registry the driver reads."""
