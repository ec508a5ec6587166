"""graphloom: knowledge-graph, evidence and corpus analytics as Spark DataFrame plans."""
