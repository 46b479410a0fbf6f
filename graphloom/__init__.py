"""graphloom: graph, ranking, scoring, roll-up, text and event analytics as Spark plans."""
