"""Reading documents, byte files, office packages and exchange files."""
