"""Document intelligence as Spark jobs: split, link, index, rank and maintain a corpus of Markdown."""
