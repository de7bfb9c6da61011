"""loomgraph: relational and graph analytics of source trees on PySpark."""
