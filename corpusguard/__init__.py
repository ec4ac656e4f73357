"""Find and remove sensitive data in text collections, and prepare and evaluate
labelled mail corpora, as PySpark DataFrame queries."""
