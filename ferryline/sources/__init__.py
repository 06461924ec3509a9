"""Where rows come from and go to: files, JDBC, versioned targets, state, audit trail."""
