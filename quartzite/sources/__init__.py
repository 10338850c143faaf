"""Where rows come from: the versioned store, its catalog, and external Parquet tables."""
