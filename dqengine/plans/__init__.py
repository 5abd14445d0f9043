"""Planning and running: which passes compute which analyzers."""
