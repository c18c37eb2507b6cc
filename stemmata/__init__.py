"""stemmata: text-reuse and parallel-corpus analytics as Spark plans."""
