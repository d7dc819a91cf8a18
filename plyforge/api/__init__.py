"""Database facade, command line and JSON-RPC over it."""
