"""DataFrame operators: profiles, joins, windows, selection, trajectories, units, stages and vector search."""
