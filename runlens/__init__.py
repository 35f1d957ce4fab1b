"""runlens: Spark-native analysis of multi-agent run transcripts."""
