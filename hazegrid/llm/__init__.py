"""Training-data operators over documents, web pages and benchmark items. Nothing outside imports this."""
