"""Reading and writing of corpora, manuals, figures, audit logs and evaluation sets."""
