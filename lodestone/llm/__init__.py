"""Operations on training corpora; nothing outside this subpackage imports it."""
