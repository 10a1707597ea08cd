"""tomeloom: document corpora, retrieval and curation as Spark DataFrames."""
