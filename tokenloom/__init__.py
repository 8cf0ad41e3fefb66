"""tokenloom: analytics over text corpora, tokens, scores and embeddings, as Spark DataFrame functions."""
