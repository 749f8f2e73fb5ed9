"""The engine over HTTP and on the command line."""
