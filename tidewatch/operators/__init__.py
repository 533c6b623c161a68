"""DataFrame operators: tables in, tables out, every clock an explicit ``as_of``."""
