"""quillmesh: retrieval and analytics over code and document corpora as Spark jobs."""
