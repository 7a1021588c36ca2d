"""Training-data operators: archives, search, packing, duplicates, personal data, tokens, pages, chats, quality, url trust."""
