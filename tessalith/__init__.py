"""Analytics for transcripts of speech, and for corpora of text, on Spark DataFrames."""
