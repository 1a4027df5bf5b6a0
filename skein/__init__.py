"""Knowledge-graph analytics on Spark: tables of documents, mentions, triples, nodes and edges."""
