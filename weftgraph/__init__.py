"""weftgraph: knowledge-graph data synthesis and corpus preparation on Spark DataFrames."""
