"""Where rows come from and go to: inline tables, files, the catalog and its management commands."""
