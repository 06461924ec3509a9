"""Load jobs: full, incremental, and a whole migration in dependency order."""
